"""Sources and sinks over files that are written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul import sinks
from tablehaul.operators import validate
from tablehaul.plans import catalogues, legacy, validation
from tablehaul.plans.registry import query
from tablehaul.session import new_output
from tablehaul.sources import markup, tables

HEADS = list(markup.LOCATED.values())


def cell(value: Column, index: int | None = None, merge: Column | None = None) -> Column:
    place = "" if index is None else f' ss:Index="{index}"'
    down = F.lit("") if merge is None else F.concat(F.lit(' ss:MergeDown="'), merge.cast("string"), F.lit('"'))
    return F.concat(F.lit(f"<Cell{place}"), down, F.lit('><Data ss:Type="String">'), F.coalesce(value.cast("string"), F.lit("")), F.lit("</Data></Cell>"))


def write_markup(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Every target catalogue as a spreadsheet document; the object's name is one cell merged over all its rows.

    A document holds one table's fields, so it is one row before it is written.
    """
    t = catalogues.targets(spark, sf_dir)
    n = t.groupBy("object", "variant").agg(F.count("*").alias("n"))
    first = F.col("ordinal") == 1
    title = F.when(first, cell(F.col("object"), 2, F.col("n") - 1)).otherwise("")
    group = F.when(first, cell(F.col("field_group"))).otherwise(cell(F.col("field_group"), 3))
    importance = F.when(F.col("is_mandatory"), "mandatory for all").otherwise("optional")
    rest = [F.col("description"), importance, F.col("data_type"), F.col("length"), F.col("decimal"), F.concat(F.lit("S_"), F.upper("table")), F.upper("field_name")]
    row = F.concat(F.lit("<Row>"), title, group, *[cell(c) for c in rest], F.lit("</Row>"))
    rows = t.join(n, ["object", "variant"]).groupBy("object", "variant").agg(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row")))).alias("rows"))
    head = F.concat(F.lit("<Row>"), *[cell(F.lit(h), 2 if not i else None) for i, h in enumerate(HEADS)], F.lit("</Row>"))
    sheet = F.concat(F.lit('<Worksheet ss:Name="Field List"><Table>'), head, F.array_join("rows.row", ""), F.lit("</Table></Worksheet>"))
    start = '<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">'
    doc = F.concat(F.lit(start), sheet, F.lit("</Workbook>"))
    rows.select(F.xxhash64("object").alias("part"), "variant", doc.alias("value")).write.partitionBy("variant", "part").text(path)


MARKUP_SQL = f"""WITH {catalogues.TARGETS} SELECT object, lower(variant) AS variant, lower(field_name) AS field_name, description, is_mandatory, field_group, is_key,
  data_type, length, decimal, "table", ordinal FROM targets"""


def _markup_rows(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    path = new_output(spark, "markup")
    write_markup(spark, sf_dir, path)
    return markup.carry_merged(markup.read_markup_cells(spark, path, repair=repair))


@query("markup_catalogue", MARKUP_SQL)
def markup_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target catalogues out of spreadsheet documents, one for each object and variant."""
    variant = F.lower(F.regexp_extract("file", "variant=([^/]+)", 1))
    rows = markup.target_dictionary(_markup_rows(spark, sf_dir, False), variant)
    return rows.select(
        F.col("sheet").alias("object"), "variant", "field_name", "description", "is_mandatory", "field_group", "is_key", "data_type", "length", "decimal", "table", "ordinal"
    )


@query(
    "markup_located",
    f"""WITH {catalogues.TARGETS} SELECT object AS sheet_name, field_group AS group_name, description, CAST(length AS VARCHAR) AS length, upper(field_name) AS field,
    'S_' || upper(variant) AS "table", upper(variant) || '.' || upper(field_name) AS internal_id, 'S_' || upper(variant) || '#' || upper(field_name) AS transformer_id FROM targets""",
)
def markup_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents after repair, with the columns found by the texts of their headers."""
    rows = markup.located_dictionary(_markup_rows(spark, sf_dir, True))
    return rows.select("sheet_name", "group_name", "description", "length", "field", "table", "internal_id", "transformer_id")


@query("raw_files", f"WITH {legacy.LEGACY} SELECT ordernr, custnr, trim(status) AS status, trim(prio) AS prio, total, coalesce(remark, '') AS remark FROM legacy")
def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw table as delimited text, read with every column as clean text."""
    path = new_output(spark, "raw")
    rows = legacy.legacy_orders(spark, sf_dir).select("ordernr", "custnr", "status", "prio", "total", "remark")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.read_raw_csv(spark, path)


@query(
    "template_file",
    "SELECT unnest([" + ", ".join(f"{{'position': {i}, 'header': '{h}'}}" for i, h in enumerate(validation.TEMPLATE)) + "], recursive := true) FROM (SELECT count(*) FROM orders)",
)
def template_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a load file that has been written, as a template."""
    path = new_output(spark, "template")
    wanted = validation.template_layout(spark, sf_dir)
    named = wanted.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(wanted.columns, validation.TEMPLATE, strict=True)])
    sinks.write_load_file(named, path)
    rows = list(enumerate(tables.read_template(spark, path)))
    return spark.createDataFrame(rows, "position int, header string")


@query(
    "reject_file",
    f"""WITH {legacy.CHECKED} SELECT order_no AS "__rownum", array_to_string(errors, '|') AS "__errors", errors[1] AS "__first_error", status AS "STATUS" FROM checked WHERE len(errors) > 0""",
)
def reject_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects written as a file, in one run of the plan, and read back."""
    path = new_output(spark, "rejects")
    sinks.write_rejects(validate.rejected(legacy.checked_orders(spark, sf_dir), "order_no", validation.RUN), path)
    back = spark.read.options(header=True, escape='"').csv(path)
    return back.select(F.col("__rownum").cast("long").alias("__rownum"), "__errors", "__first_error", F.coalesce("STATUS", F.lit("")).alias("STATUS"))


@query(
    "stats_files",
    f"""WITH {legacy.CHECKED}, c AS (SELECT e AS error_rule, count(*) AS errors FROM (SELECT unnest(errors) AS e FROM checked) GROUP BY 1)
    SELECT unnest(['csv', 'json']) AS kind, error_rule, errors FROM c""",
)
def stats_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by rule in both formats of a statistics file, read back."""
    path = new_output(spark, "stats")
    sinks.write_stats(validation.reject_by_rule(spark, sf_dir), path)
    shape = [F.col("error_rule"), F.col("errors").cast("long").alias("errors")]
    csv = spark.read.options(header=True).csv(f"{path}/csv").select(F.lit("csv").alias("kind"), *shape)
    return csv.unionByName(spark.read.json(f"{path}/json").select(F.lit("json").alias("kind"), *shape))


@query(
    "load_files_from_table",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
)
def load_files_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet table as clean text, through a load file."""
    path = new_output(spark, "load")
    rows = tables.read_raw_parquet(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    sinks.write_load_file(rows, path)
    return tables.read_raw_csv(spark, path, lineSep="\r\n")
