"""Row rules, reject routing and table rules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions import parsing
from tablehaul.functions.text import is_blank
from tablehaul.operators.project import quoted

ERRORS = "errors"


@dataclass(frozen=True)
class Rule:
    field: str
    key: bool = False
    required: bool = False
    type: str = "string"
    max_length: int | None = None


def collect_rules(rules: DataFrame) -> list[Rule]:
    """A rules table (one row per field of one target table) as plan-building metadata."""
    return [Rule(**{k: v for k, v in r.asDict().items() if v is not None}) for r in
            rules.select("field", "key", "required", "type", "max_length").collect()]


def type_error(value: Column, kind: str) -> Column:
    """True when a non-blank value does not parse as its type."""
    if kind == "string":
        return F.lit(False)
    parsed = {
        "decimal": parsing.parse_number,
        "int": parsing.parse_integer,
        "integer": parsing.parse_integer,
        "date": parsing.parse_date,
        "time": parsing.parse_time,
    }[kind](value)
    return ~is_blank(value) & parsed.isNull()


def row_checks(rules: Iterable[Rule], extended: bool = False) -> list[tuple[str, Column]]:
    """(label, failing condition) per rule in field order.

    The plain set is the required check; ``extended`` adds length and type.
    """
    checks = []
    for rule in rules:
        value = quoted(rule.field.lower())
        label = rule.field.upper()
        if rule.required:
            checks.append((f"{label}.required", value == ""))
        if extended and rule.max_length is not None:
            checks.append((f"{label}.max_length", F.length(value) > rule.max_length))
        if extended and rule.type != "string":
            checks.append((f"{label}.{rule.type}", type_error(value, rule.type)))
    return checks


def with_errors(df: DataFrame, checks: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add the list of failed rule labels per row, behind those it has; no row leaves and nothing is shuffled."""
    labels = [F.when(failed, F.lit(label)).otherwise("") for label, failed in checks]
    found = F.array_remove(F.array(*labels), "") if labels else F.array().cast("array<string>")
    return df.withColumn(ERRORS, F.concat(ERRORS, found) if ERRORS in df.columns else found)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.size(ERRORS) == 0).drop(ERRORS)


def rejected(df: DataFrame, row_no: str, run_time: datetime | None = None) -> DataFrame:
    """Reject rows: number, all errors, first error, run time, then the target columns."""
    stamp = (run_time or datetime.now(timezone.utc)).isoformat()
    fields = [c for c in df.columns if c not in (ERRORS, row_no)]
    return df.filter(F.size(ERRORS) > 0).select(
        quoted(row_no).alias("__rownum"),
        F.concat_ws("|", ERRORS).alias("__errors"),
        F.try_element_at(ERRORS, F.lit(1)).alias("__first_error"),
        F.lit(stamp).alias("__timestamp"),
        *[quoted(c).alias(c.upper()) for c in fields],
    )


def rule_counts(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows failing each rule, straight from the conditions: one aggregation, one row per task."""
    row = df.agg(*[F.count_if(failed).alias(f"c{i}") for i, (_, failed) in enumerate(checks)])
    entries = [F.struct(F.lit(label).alias("error_rule"), F.col(f"c{i}").alias("errors")) for i, (label, _) in enumerate(checks)]
    return row.select(F.inline(F.array(*entries))).filter(F.col("errors") > 0)


def error_rows(df: DataFrame) -> DataFrame:
    """One row per failed rule.

    The outer form keeps the planner from evaluating the whole list a second time as a filter.
    """
    kept = [quoted(c) for c in df.columns if c != ERRORS]
    return df.select(*kept, F.explode_outer(ERRORS).alias("error_rule")).filter(F.col("error_rule").isNotNull())


def errors_by_rule(df: DataFrame) -> DataFrame:
    """The same from the error lists of rows that are checked already."""
    return (
        error_rows(df.select(ERRORS))
        .groupBy("error_rule")
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def errors_by_field(by_rule: DataFrame) -> DataFrame:
    return by_rule.groupBy(
        F.split_part("error_rule", F.lit("."), F.lit(1)).alias("field")
    ).agg(F.sum("errors").alias("errors"))


def in_out_counts(df: DataFrame) -> DataFrame:
    """Rows in, out and rejected in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.size(ERRORS) == 0).alias("rows_out"),
        F.count_if(F.size(ERRORS) > 0).alias("rows_rejected"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are empty or occur more than once, with their row count.

    Counting combines on the map side, so one very frequent key costs no more than a rare one.
    """
    empty = F.lit(False)
    for k in keys:
        empty = empty | is_blank(quoted(k))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows_with_key"))
        .withColumn("key_empty", empty)
        .filter((F.col("rows_with_key") > 1) | F.col("key_empty"))
    )


def rows_with_bad_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The offending rows themselves. A semi join, so the skewed side can be split at run time."""
    bad = duplicate_keys(df, keys).select(*keys)
    same = None
    left, right = df.alias("l"), bad.alias("r")
    for k in keys:
        equal = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = equal if same is None else same & equal
    return left.join(right, same, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    right = parent.select(*[quoted(p).alias(f"__{c}") for c, p in zip(child_keys, parent_keys)])
    same = None
    for c in child_keys:
        equal = quoted(c) == F.col(f"__{c}")
        same = equal if same is None else same & equal
        child = child.filter(quoted(c).isNotNull())
    return child.join(right, same, "left_anti")


def reconcile(rows_in: DataFrame, rows_out: DataFrame, rows_rejected: DataFrame) -> DataFrame:
    """Record-count check over three separately stored tables: in = out + rejected."""
    def count(df: DataFrame, part: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))

    parts = count(rows_in, "in").unionByName(count(rows_out, "out")).unionByName(count(rows_rejected, "rejected"))
    pick = lambda p: F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0))
    return parts.agg(
        pick("in").alias("rows_in"), pick("out").alias("rows_out"), pick("rejected").alias("rows_rejected")
    ).withColumn("balanced", F.col("rows_in") == F.col("rows_out") + F.col("rows_rejected"))


def overlay_rules(base: DataFrame, override: DataFrame) -> DataFrame:
    """Dictionary key/required flags, overridden per field by a rules table where it is set."""
    left = base.select(F.upper("field").alias("field"), F.col("key").alias("b_key"), F.col("required").alias("b_req"))
    right = override.select(F.upper("field").alias("field"), F.col("key").alias("o_key"), F.col("required").alias("o_req"))
    no = F.lit(False)
    return left.join(right, "field", "full_outer").select(
        "field",
        F.coalesce("o_key", "b_key", no).alias("key"),
        F.coalesce("o_req", "b_req", no).alias("required"),
    )


def inconsistent_rules(rules: DataFrame) -> DataFrame:
    """Key fields that are not required; a non-empty result stops a run."""
    return rules.filter(F.col("key") & ~F.col("required")).select(
        "field", F.lit("key=true but required=false").alias("issue")
    )


def require_consistent(rules: DataFrame) -> None:
    """Raises with the number of fields at fault; ``inconsistent_rules`` lists them."""
    bad = inconsistent_rules(rules).agg(F.count(F.lit(1)).alias("n"), F.min("field").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"key=true but required=false for {bad['n']} fields, the first is {bad['first']}")
