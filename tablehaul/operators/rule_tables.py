"""Transforms whose rules and value tables are data: any number of entries, one keyed join for all fields.

The different combinations of the mapped fields' values are laid out as ``(field, value)`` cells, joined once with the value
tables of all fields, gathered to one map for each combination, and joined back. A value that fills a third of a column is a
cell for each combination it stands in, not for each row; where it is still frequent, adaptive execution splits its part of
the join, as the value table holds it once. Small value tables and small sets of combinations are broadcast at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions.text import strip
from tablehaul.operators.project import quoted
from tablehaul.operators.transform import FieldTransform, Settings, apply_transforms


def collect_transforms(rules: DataFrame) -> list[FieldTransform]:
    """One rule for each field of one target table, as plan-building metadata; of several for a field the last counts."""
    order = ["position"] if "position" in rules.columns else []
    expression = F.col("expression") if "expression" in rules.columns else F.lit(None).cast("string")
    rows = rules.orderBy(*order).select("target_field", "transformation_type", "placeholder_value", expression).collect()
    return [FieldTransform(r[0], r[1] or "direct", r[2] or "", r[3]) for r in rows]


def collect_settings(settings: DataFrame) -> Settings:
    """The settings row; what it leaves out has its default."""
    row = settings.first()
    given = {} if row is None else {k: v for k, v in row.asDict().items() if k in Settings.__dataclass_fields__ and v is not None}
    return Settings(**given)


def value_table(values: DataFrame, fields: list[str], case_sensitive: bool) -> DataFrame:
    """``field``, ``value``, ``target``: one target for each source value of the fields, that with the smallest position."""
    fold = (lambda c: c) if case_sensitive else F.lower
    order = F.struct("position", "target_value") if "position" in values.columns else F.col("target_value")
    chosen = values.filter(F.lower("target_field").isin(fields) & F.col("source_value").isNotNull())
    return chosen.groupBy(F.lower("target_field").alias("field"), fold(F.col("source_value")).alias("value")).agg(
        F.min_by("target_value", order).alias("target")
    )


def apply_rule_tables(df: DataFrame, transforms: list[FieldTransform], values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All transforms of a table, with value tables ``(target_field, source_value, target_value[, position])`` of any size.

    Source values that a table lacks stay as they are. No row is lost or doubled: rows meet the combination of their values,
    and every combination stands once. Policies are those of ``apply_transforms``.
    """
    listed = {t.target.lower() for t in transforms if t.kind == "direct"}
    names = [c for c in df.columns if c.lower() in listed]
    if not names:
        return apply_transforms(df, transforms, settings)
    fields = [c.lower() for c in names]
    fold = (lambda c: c) if settings.case_sensitive_mappings else F.lower
    trim = strip if settings.trim_whitespace else (lambda c: c)
    keys = [f"__value{i}" for i in range(len(names))]
    keyed = df.withColumns({k: fold(trim(quoted(c).cast("string"))) for k, c in zip(keys, names, strict=True)})
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(k).alias("value")) for f, k in zip(fields, keys, strict=True)])
    long = keyed.select(*keys).distinct().select(*keys, F.inline_outer(cells))
    hits = long.join(value_table(values, fields, settings.case_sensitive_mappings), ["field", "value"])
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "target"))).alias("__found"))
    found = found.select(*[F.col(k).alias(f"__of{k}") for k in keys], "__found")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in keys])
    joined = keyed.join(found, same, "left").select(*[quoted(c) for c in df.columns], "__found")
    return apply_transforms(joined, transforms, settings, F.col("__found")).drop("__found")
