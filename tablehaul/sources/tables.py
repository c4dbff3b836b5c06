"""Raw tables and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablehaul.operators.project import as_clean_text


def read_raw_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Delimited table, every column text, null as the empty string, cells stripped.

    Quoted line breaks are read when ``multiLine=True`` is passed; without it files are splittable.
    """
    defaults = {"header": True, "escape": '"', "inferSchema": False}
    return as_clean_text(spark.read.options(**{**defaults, **options}).csv(path))


def read_raw_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return as_clean_text(df.select(*columns) if columns else df)


def read_template(spark: SparkSession, path: str) -> list[str]:
    """Output columns and their order from the first line of a delimited file."""
    first = spark.read.options(header=False, escape='"').csv(path).limit(1).collect()
    return [c for c in first[0] if c is not None] if first else []
