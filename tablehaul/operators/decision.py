"""Final decision per source field, residual targets and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.functions.classify import is_constant
from tablehaul.operators.match import BY


def decision_table(sources: DataFrame, matched: DataFrame, manual: DataFrame, skipped: DataFrame) -> DataFrame:
    """mapped, manual, skipped or pending per source field; matched wins over manual.

    ``matched``: source_field, target_field, confidence. ``manual``: field_name, target_field,
    confidence. ``skipped``: field_name, confidence, reason. Every match and every skip is a row of
    its own, as in the log it comes from; a manual mapping counts where there is no match, and a
    source without any of these is pending.
    """
    def rows(df: DataFrame, field: str, target, status: str, confidence, rationale) -> DataFrame:
        return df.select(
            *BY, F.col(field).alias("source_field"), target.alias("target_field"),
            F.lit(status).alias("status"), confidence.alias("confidence"), rationale.alias("rationale"),
        )

    none = F.lit("")
    hits = matched.filter(F.col("target_field").isNotNull())
    key = [*BY, "source_field"]
    mapped = rows(hits, "source_field", F.col("target_field"), "mapped", F.col("confidence"), F.lit("Exact field match"))
    given = rows(manual, "field_name", F.col("target_field"), "manual", F.col("confidence"), F.lit("Manual mapping from central memory"))
    left_out = rows(skipped, "field_name", none, "skipped", F.col("confidence"), F.col("reason"))
    decided = mapped.unionByName(given.join(mapped.select(key).distinct(), key, "left_anti")).unionByName(left_out)
    open_ = rows(sources, "field_name", none, "pending", F.lit(0.0), F.lit("Geen geschikte match gevonden"))
    return decided.unionByName(open_.join(decided.select(key).distinct(), key, "left_anti"))


def residual_targets(targets: DataFrame, matched: DataFrame) -> DataFrame:
    """Targets nobody maps to: a constant (0.90) when they look operational, else derived (0.80)."""
    used = matched.filter(F.col("target_field").isNotNull()).select(*BY, F.col("target_field").alias("field_name")).distinct()
    constant = is_constant(F.col("field_name"), F.col("description"))
    return targets.join(used, [*BY, "field_name"], "left_anti").select(
        *BY,
        "field_name",
        F.lit("DERIVED").alias("decision"),
        F.when(constant, 0.90).otherwise(0.80).alias("confidence"),
        F.when(constant, "constant_detection").otherwise("business_logic_required").alias("match_type"),
        F.when(constant, "constant").otherwise("derive").alias("rule"),
    )


def conflicts(manual: DataFrame, exact: DataFrame) -> DataFrame:
    """Manual and exact rows that give one target to different sources."""
    m = manual.select(*BY, "target_field", F.col("field_name").alias("manual_source"))
    e = exact.select(*BY, "target_field", F.col("source_field").alias("exact_source"))
    return m.join(e, [*BY, "target_field"]).filter(F.col("manual_source") != F.col("exact_source"))


def with_descriptions(decided: DataFrame, sources: DataFrame, targets: DataFrame, manual: DataFrame) -> DataFrame:
    """Adds ``source_description`` (``none`` where there is none) and ``target_description`` to a decision table.

    A manual mapping's own description of its target comes first, then that of the catalogue's field of the same name, of several
    the one with the smallest ordinal; what has no target has an empty one.
    """
    first = lambda df, name, told: df.groupBy(*BY, name.alias("__name")).agg(F.min_by("description", "ordinal").alias(told))
    s, t = first(sources, F.col("field_name"), "__source"), first(targets, F.upper("field_name"), "__target")
    m = manual.groupBy(*BY, F.col("field_name").alias("__name")).agg(F.max("target_description").alias("__own"))
    by_source = decided.withColumn("__name", F.col("source_field")).join(s, [*BY, "__name"], "left").join(m, [*BY, "__name"], "left")
    both = by_source.withColumn("__name", F.upper("target_field")).join(t, [*BY, "__name"], "left")
    some = lambda c: F.when(c != "", c)
    own = F.when(F.col("status") == "manual", some(F.col("__own")))
    target = F.when(F.col("target_field") != "", F.coalesce(own, "__target"))
    return both.select(*decided.columns, F.coalesce(some(F.col("__source")), F.lit("none")).alias("source_description"), F.coalesce(target, F.lit("")).alias("target_description"))
