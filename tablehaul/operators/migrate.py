"""The transform command as one plan: clean, map, translate, check, write both outcomes, lay out, sum up.

The rows are read once and written once; accepted and rejected rows, the counts by rule and the summary come from that one
write. What is read back is what was written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import project, rule_tables, validate
from tablehaul.operators.project import MappingRow
from tablehaul.operators.transform import FieldTransform, Settings
from tablehaul.operators.validate import Rule


@dataclass(frozen=True)
class Job:
    """What one target table needs; lists have an entry for each field, so they are small whatever the data's size."""

    object_name: str
    variant: str
    targets: list[str]
    mapping: list[MappingRow]
    rules: list[Rule]
    transforms: list[FieldTransform] = field(default_factory=list)
    settings: Settings = Settings()
    template: list[str] | None = None
    extended: bool = False


@dataclass(frozen=True)
class Result:
    accepted: DataFrame
    rejected: DataFrame
    summary: DataFrame
    warnings: list[tuple[str, str]]


def labels(job: Job) -> list[str]:
    """Every label that a row can fail with: those of transforms that call null an error, then those of the rules."""
    nulls = [f"{t.target.upper()}.null" for t in job.transforms if t.kind == "direct"] if job.settings.null_handling == "error" else []
    return nulls + [label for label, _ in validate.row_checks(job.rules, job.extended)]


def checked(raw: DataFrame, job: Job, values: DataFrame, row_no: str) -> DataFrame:
    """Target-shaped rows with their errors, before they are told apart. Rows that a ``skip`` policy marks fail nothing."""
    require = [r.field for r in job.rules if r.key and not r.required]
    if require:
        raise ValueError(f"key=true but required=false for {len(require)} fields, the first is {require[0]}")
    cleaned = project.as_clean_text(raw, [c for c in raw.columns if c != row_no])
    mapped = project.apply_mapping(cleaned, job.targets, job.mapping, keep=[row_no])
    translated = rule_tables.apply_rule_tables(mapped, job.transforms, values, job.settings)
    return validate.with_errors(translated, validate.row_checks(job.rules, job.extended))


def warnings(raw: DataFrame, job: Job) -> list[tuple[str, str]]:
    """Mapped headers that the table lacks, and targets that the template leaves out."""
    missing = [("missing_source_column", c) for c in project.missing_sources(raw, job.mapping)]
    return missing + [("target_not_in_template", t) for t in layout(job).ignored]


def layout(job: Job) -> project.Layout:
    return project.plan_layout(job.targets, job.template, {r.field.upper(): (r.key, r.required) for r in job.rules})


def run(raw: DataFrame, job: Job, values: DataFrame, path: str, run_ts: str, row_no: str) -> Result:
    """Carries a job out below ``path`` at the address of its object, variant and run; a repeated run replaces itself.

    ``raw`` is counted by itself, which reads no column of a Parquet table, so rows lost on the way show as ``lost``.
    """
    spark, names = raw.sparkSession, labels(job)
    rows, outcomes = sinks.count_outcomes(checked(raw, job, values, row_no), names)
    outcome = F.when(F.size(validate.ERRORS) == 0, "accepted").otherwise("rejected")
    sinks.write_addressed(rows.withColumn("outcome", outcome), path, job.object_name, job.variant, run_ts, ("outcome",))
    here = (F.col("object") == job.object_name) & (F.col("variant") == job.variant) & (F.col("run_ts") == run_ts)
    back = sinks.read_by_address(spark, path).filter(here).drop(*sinks.ADDRESS)
    good = back.filter(F.col("outcome") == "accepted").drop("outcome", validate.ERRORS)
    bad = validate.rejected(back.filter(F.col("outcome") == "rejected").drop("outcome"), row_no)
    return Result(
        project.apply_layout(good, layout(job)), bad, sinks.summary(spark, raw.count(), outcomes.get, names), warnings(raw, job)
    )
