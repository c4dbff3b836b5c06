"""Choice of the file to read when an object has several formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats from preferred to fallback.
DICTIONARY_FORMATS = ["xml", "xlsx"]
SOURCE_FORMATS = ["xlsx", "csv"]


def list_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Files named ``object_variant.extension`` as (path, object, variant, format).

    With ``known`` (object, variant) the name decides among these, so either may hold underscores;
    without it the object ends at the first one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    parts = r"([^/]+?)_([^/]+)\.([A-Za-z0-9]+)$"
    take = lambda i: F.regexp_extract("path", parts, i)
    if known is not None:
        named = files.select("path", "length", F.concat_ws("_", take(1), take(2)).alias("__name"), F.lower(take(3)).alias("format"))
        pairs = known.select("object", "variant", F.concat_ws("_", "object", "variant").alias("__name")).distinct()
        return named.join(pairs, "__name").select("path", "length", "object", "variant", "format")
    return files.select("path", "length", take(1).alias("object"), take(2).alias("variant"), F.lower(take(3)).alias("format"))


def prefer(files: DataFrame, formats: list[str]) -> DataFrame:
    """One file per object and variant: the most preferred format, then the path."""
    rank = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("format"))
    known = files.withColumn("__rank", rank).filter(F.col("__rank") > 0)
    best = F.min_by(F.struct("path", "format"), F.struct("__rank", "path"))
    return known.groupBy("object", "variant").agg(best.alias("b")).select("object", "variant", "b.path", "b.format")
