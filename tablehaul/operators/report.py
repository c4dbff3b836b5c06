"""Summary rows for reports: key figures, chart rows, head rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.operators.project import quoted


def key_figures(row: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """One row of figures as (position, label, value)."""
    entries = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(k).alias("label"), v.cast("string").alias("value"))
            for i, (k, v) in enumerate(labels.items())
        ]
    )
    return row.select(F.inline(entries))


def source_figures(sources: DataFrame, problems: DataFrame) -> DataFrame:
    """Figures of source indexing; ``problems`` comes from ``catalog.header_check``."""
    total = sources.agg(F.count(F.lit(1)).alias("n"))
    kind = lambda k: F.count_if(F.col("problem") == k)
    found = problems.agg(kind("duplicate").alias("d"), F.coalesce(F.sum(F.when(F.col("problem") == "empty", F.col("columns"))), F.lit(0)).alias("e"))
    left = key_figures(total, {"Total Columns": F.col("n")})
    right = key_figures(found, {"Duplicates": F.col("d"), "Empty Headers": F.col("e")})
    return left.unionByName(right.withColumn("position", F.col("position") + 1))


def target_figures(targets: DataFrame) -> DataFrame:
    row = targets.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_mandatory").alias("m"), F.count_if("is_key").alias("k")
    )
    return key_figures(row, {"Total Fields": F.col("n"), "Mandatory": F.col("m"), "Keys": F.col("k")})


def mapping_figures(coverage: DataFrame) -> DataFrame:
    """Figures of a mapping over all objects in ``coverage`` (from ``match.coverage``)."""
    row = coverage.agg(
        F.sum("targets").alias("t"), F.sum("mapped").alias("m"), F.sum("unmapped").alias("u"), F.sum("unused_sources").alias("s")
    )
    share = F.when(F.col("t") > 0, F.col("m") / F.col("t") * 100).otherwise(0.0)
    return key_figures(
        row,
        {
            "Mapped": F.col("m"), "Unmapped": F.col("u"), "Unused Sources": F.col("s"), "Unused Targets": F.col("u"),
            "Coverage": F.format_string("%.1f%%", share),
        },
    )


def mapping_with_samples(mapping: DataFrame, source_samples: DataFrame, target_samples: DataFrame) -> DataFrame:
    """Mapping rows with the sample values of both sides (from ``profile.sample_values``)."""
    def listed(samples: DataFrame, key: str, name: str) -> DataFrame:
        # At most k samples per field, so the lists are short.
        entries = F.array_sort(F.collect_list(F.struct("rank", "value")))
        return samples.groupBy(F.col("field").alias(key)).agg(F.transform(entries, lambda e: e["value"]).alias(name))

    s = listed(source_samples, "source_header", "source_samples")
    t = listed(target_samples, "__target", "target_samples")
    joined = mapping.join(s, "source_header", "left").join(t, F.lower("target_field") == F.col("__target"), "left")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {"source_samples": F.coalesce("source_samples", none), "target_samples": F.coalesce("target_samples", none)}
    ).drop("__target")


def top_rows(df: DataFrame, label: str, value: str, k: int = 10) -> DataFrame:
    """The k largest values; equal values in label order. A limited sort, no full sort."""
    return df.orderBy(F.col(value).desc(), F.col(label)).limit(k)


def head_rows(df: DataFrame, row_no: str, rows: int = 200, columns: int = 3) -> DataFrame:
    """First rows and columns with a list of the blank ones among them."""
    shown = [c for c in df.columns if c != row_no][:columns]
    blank = F.array_compact(F.array(*[F.when(F.trim(quoted(c)) == "", F.lit(f"{c}.required")) for c in shown]))
    first = df.orderBy(row_no).limit(rows)
    return first.select(F.col(row_no).alias("__rownum"), *[quoted(c) for c in shown], blank.alias("errors"))
