"""Writers: load files, rejects, statistics, profile exports, partitioned output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The load file dialect (UTF-8, comma, doubled quotes, CRLF).
LOAD_FILE = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "lineSep": "\r\n",
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_load_file(df: DataFrame, path: str, mode: str = "error") -> None:
    """Load file in parts of the same dialect; every part carries the annotated header."""
    df.write.mode(mode).options(**LOAD_FILE).csv(path)


def write_routed(checked: DataFrame, path: str, errors: str = "errors", mode: str = "error") -> None:
    """Accepted and rejected rows in one pass, as partitions ``outcome=accepted`` and ``outcome=rejected``.

    Writing both from one scan spares a second reading of the source or a cache of it.
    """
    outcome = F.when(F.size(errors) == 0, "accepted").otherwise("rejected")
    checked.withColumn("outcome", outcome).write.mode(mode).partitionBy("outcome").parquet(path)


def write_rejects(rejected: DataFrame, path: str, mode: str = "error") -> bool:
    """Rejects with their error columns; without any, nothing stays at ``path``. The plan runs once."""
    counted = Observation()
    observed = rejected.observe(counted, F.count(F.lit(1)).alias("rows"))
    observed.write.mode(mode).options(**{**LOAD_FILE, "lineSep": "\n"}).csv(path)
    if counted.get["rows"]:
        return True
    if mode != "append":
        jvm, context = rejected.sparkSession._jvm, rejected.sparkSession.sparkContext
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return False


def count_rows(df: DataFrame, name: str = "rows_in") -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass. Exact where no shuffle follows before the write: a stage that writes counts a
    task once, however often it is tried."""
    counted = Observation()
    return df.observe(counted, F.count(F.lit(1)).alias(name)), counted


def count_outcomes(checked: DataFrame, labels: list[str], errors: str = "errors") -> tuple[DataFrame, Observation]:
    """The same rows; accepted and rejected ones and failures of each rule are counted as they pass."""
    counted = Observation()
    by_rule = [F.count_if(F.array_contains(errors, label)).alias(f"rule{i}") for i, label in enumerate(labels)]
    outcomes = [F.count_if(F.size(errors) == 0).alias("rows_out"), F.count_if(F.size(errors) > 0).alias("rows_rejected")]
    return checked.observe(counted, *outcomes, *by_rule), counted


def summary(spark: SparkSession, rows_in: int, outcomes: dict[str, int], labels: list[str]) -> DataFrame:
    """``part``, ``name``, ``n``: rows in, out and rejected, rows lost on the way, errors by rule and by field.

    The rows are lost if neither accepted nor rejected rows account for them; the counts balance if ``lost`` is zero.
    """
    out, rejected = outcomes["rows_out"], outcomes["rows_rejected"]
    rows = [("rows", "in", rows_in), ("rows", "out", out), ("rows", "rejected", rejected), ("rows", "lost", rows_in - out - rejected)]
    by_field: dict[str, int] = {}
    for i, label in enumerate(labels):
        if n := outcomes[f"rule{i}"]:
            rows.append(("errors_by_rule", label, n))
            field = label.split(".")[0]
            by_field[field] = by_field.get(field, 0) + n
    rows += [("errors_by_field", field, n) for field, n in by_field.items()]
    return spark.createDataFrame(rows, "part string, name string, n long")


def write_stats(stats: DataFrame, path: str, mode: str = "error") -> None:
    """A small statistics table as CSV and as JSON lines."""
    stats.write.mode(mode).option("header", True).csv(f"{path}/csv")
    stats.write.mode(mode).json(f"{path}/json")


def profile_export(profile: DataFrame) -> DataFrame:
    """Profile in export column order and naming."""
    names = {
        "field": "Field",
        "type": "Type",
        "quality_score": "Quality Score",
        "missing_pct": "Missing %",
        "invalid_pct": "Invalid %",
        "unique_pct": "Unique %",
        "count": "Count",
        "missing": "Missing",
        "invalid": "Invalid",
        "unique": "Unique",
    }
    return profile.select(*[F.col(c).alias(n) for c, n in names.items()])


def top_values_export(top: DataFrame, field: str) -> DataFrame:
    rows = top.filter(F.col("field") == field)
    return rows.orderBy("rank").select(F.col("value").alias("Value"), F.col("count").alias("Count"))


def list_export(items: DataFrame, column: str) -> DataFrame:
    return items.select(F.col(column).cast("string").alias("Item"))


def write_addressed(df: DataFrame, path: str, object_name: str, variant: str, run_ts: str, by: tuple[str, ...] = ()) -> None:
    """Output addressed by object, variant and run time; the same run written again takes the place of the first."""
    tagged = df.withColumns(
        {"object": F.lit(object_name), "variant": F.lit(variant), "run_ts": F.lit(run_ts)}
    )
    write_by_address(tagged, path, by)


ADDRESS = ["object", "variant", "run_ts"]
COMMIT = "commit_id"


def write_by_address(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """The same for rows of many objects; a hot object is written by many tasks at once.

    Only the addresses among the rows are replaced. Rows carry the number of their commit, and a manifest, written last,
    names the commit that counts at each address. Until then, and if the write breaks off, a reader of
    ``read_by_address`` finds the address empty rather than half or doubled; writing it again mends it.
    """
    commit = uuid.uuid4().hex
    rows = df.withColumn(COMMIT, F.lit(commit)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy(*ADDRESS, *by).parquet(path)
    spark = df.sparkSession
    written = read_text_address(spark, path).filter(F.col(COMMIT) == commit).groupBy(*ADDRESS, COMMIT).agg(F.count(F.lit(1)).alias("rows"))
    entries = written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    entries.partitionBy(*ADDRESS).parquet(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``object``, ``variant``, ``run_ts``, the commit that counts and its number of rows."""
    return read_text_address(spark, f"{path}/_manifest").select(*ADDRESS, COMMIT, "rows")


def read_by_address(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed runs with their address; a filter on the address prunes folders."""
    return read_text_address(spark, path).join(manifest(spark, path).drop("rows"), [*ADDRESS, COMMIT], "left_semi").drop(COMMIT)


def read_text_address(spark: SparkSession, path: str) -> DataFrame:
    """A table with its address as the text it was written as; left to itself, Spark reads ``0012`` as a number."""
    found = spark.read.parquet(path).schema
    kept = [T.StructField(f.name, T.StringType() if f.name in ADDRESS else f.dataType) for f in found.fields]
    return spark.read.schema(T.StructType(kept)).parquet(path)
