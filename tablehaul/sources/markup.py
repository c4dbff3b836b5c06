"""Spreadsheet markup (XML) dictionaries read with Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehaul.functions import parsing, text
from tablehaul.operators import scan
from tablehaul.operators.catalog import field_ids, structure_filter, with_ordinal

_SHEET = (
    "_Name string, Table struct<Row: array<struct<_Index: int, Cell: array<struct<"
    "_Index: int, _MergeDown: int, Data: struct<_VALUE: string>>>>>>"
)


def repair_markup(raw: Column) -> Column:
    """Remove comments, control characters, named entities and broken tags before parsing."""
    for pattern, replacement in (
        (r"(?s)<!--.*?-->", ""),
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
        (r"&[a-zA-Z0-9]*;", ""),
        (r"<([^/>&]*\s)&(?!#)[^>]*>", "<$1>"),
        (r"</?invalid[^>]*>", ""),
    ):
        raw = F.regexp_replace(raw, pattern, replacement)
    return raw


def read_markup_cells(spark: SparkSession, paths: str | list[str], sheet: str = "Field List", repair: bool = False) -> DataFrame:
    """Cells of one worksheet per file: file, sheet, row_no, col_no, value, merge_down.

    One worksheet is one dictionary and becomes one row before it is exploded. A cell without an
    index follows the one before it; one with an index starts a new run there.
    """
    if repair:
        files = spark.read.text(paths, wholetext=True).select(
            F.col("_metadata.file_path").alias("file"), repair_markup(F.col("value")).alias("raw")
        )
        bodies = files.select("file", F.explode(F.regexp_extract_all("raw", F.lit(r"(?s)(<(?:ss:)?Worksheet\b.*?</(?:ss:)?Worksheet>)"), F.lit(1))).alias("raw"))
        parsed = F.from_xml("raw", _SHEET, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
        sheets = bodies.select("file", parsed.alias("s")).select("file", "s.*")
    else:
        options = {"rowTag": "Worksheet", "ignoreNamespace": "true"}
        sheets = spark.read.schema(_SHEET).options(**options).xml(paths).select(F.col("_metadata.file_path").alias("file"), "*")
    rows = sheets.filter(F.col("_Name") == sheet).select("file", F.col("_Name").alias("sheet"), F.posexplode("Table.Row").alias("row_no", "row"))
    # Running column number: an index sets it, otherwise it moves on by one.
    numbered = F.aggregate(
        F.coalesce("row.Cell", F.array().cast("array<struct<_Index:int,_MergeDown:int,Data:struct<_VALUE:string>>>")),
        F.struct(F.lit(0).alias("col_no"), F.array().cast("array<struct<col_no:int,value:string,merge_down:int>>").alias("cells")),
        lambda acc, c: F.struct(
            F.coalesce(c["_Index"], acc["col_no"] + 1).alias("col_no"),
            F.concat(
                acc["cells"],
                F.array(
                    F.struct(
                        F.coalesce(c["_Index"], acc["col_no"] + 1).alias("col_no"),
                        F.nullif(text.clean(c["Data"]["_VALUE"]), F.lit("")).alias("value"),
                        F.coalesce(c["_MergeDown"], F.lit(0)).alias("merge_down"),
                    )
                ),
            ).alias("cells"),
        ),
    )
    return rows.select("file", "sheet", (F.col("row_no") + 1).alias("row_no"), F.inline(numbered["cells"]))


def carry_merged(cells: DataFrame, width: int = 0) -> DataFrame:
    """Fill rows under a vertically merged cell with its value, as far as the merge reaches.

    The forward fill looks at the latest merged cell above in the same column; a row's own cell
    wins. Returns one row per sheet row with ``cells`` by column position: as many as the widest
    row has, and at least ``width``.
    """
    widest = cells.agg(F.max("col_no")).first()[0] or 0
    return scan.fill_merged(cells, max(width, widest, 1))


def after_header(rows: DataFrame, is_header: Column) -> DataFrame:
    """Rows below the first header row of each sheet, with that header."""
    marked = rows.withColumn("__h", is_header)
    head = marked.filter("__h").groupBy("file", "sheet").agg(
        F.min("row_no").alias("__at"), F.min_by("cells", "row_no").alias("header")
    )
    below = rows.join(head, ["file", "sheet"]).filter(F.col("row_no") > F.col("__at")).drop("__at")
    return below.filter(F.exists("cells", lambda c: F.coalesce(text.strip(c), F.lit("")) != ""))


def target_dictionary(rows: DataFrame, variant: Column) -> DataFrame:
    """Target catalogue rows from the fixed column positions 2 to 10 (``rows`` from carry_merged)."""
    at = lambda i: F.get("cells", F.lit(i - 1))
    has = F.exists("cells", lambda c: F.coalesce(c, F.lit("")).contains("Sheet Name"))
    below = after_header(rows, has).withColumn("variant", variant)
    fields = below.select(
        "file", "variant", "row_no", F.lower(at(10)).alias("field_name"), at(4).alias("description"), at(9).alias("structure"),
        parsing.is_mandatory(at(5)).alias("is_mandatory"), F.coalesce(F.lower(at(3)), F.lit("")).alias("field_group"),
        F.coalesce(at(2), F.col("sheet")).alias("sheet"), at(6).alias("data_type"),
        parsing.parse_length(at(7)).alias("length"), parsing.parse_length(at(8)).alias("decimal"),
    )
    kept = structure_filter(fields, "structure", "field_name", F.col("variant"))
    kept = kept.withColumn("is_key", F.col("field_group") == "key").withColumn("table", F.lower(F.substring("structure", 3, 2**31 - 1)))
    return with_ordinal(kept, ["file", "variant"], ["row_no"])


# Header texts of a located dictionary.
LOCATED = {
    "sheet_name": "Sheet Name",
    "group_name": "Group Name",
    "description": "Field Description",
    "importance": "Importance",
    "type": "Type",
    "length": "Length",
    "decimal": "Decimal",
    "table": "SAP Structure",
    "field": "SAP Field",
}


def located_dictionary(rows: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Dictionary whose header row and columns are found by their texts.

    A header row has at least 80 % of the texts exactly, or 70 % in part. A column is the first
    whose header contains the text. Rows need a field and a structure.
    """
    headers = headers or LOCATED
    lowered = F.transform("cells", lambda c: F.lower(F.coalesce(c, F.lit(""))))
    wanted = F.array(*[F.lit(h.lower()) for h in headers.values()])
    exact = F.size(F.filter(wanted, lambda w: F.array_contains(lowered, w)))
    part = F.size(F.filter(wanted, lambda w: F.exists(lowered, lambda c: (c != "") & (c.contains(w) | F.contains(w, c)))))
    is_header = (exact >= 0.8 * len(headers)) | (part >= 0.7 * len(headers))
    below = after_header(rows, is_header)

    def cell(name: str) -> Column:
        spots = F.transform("header", lambda c, i: F.when(F.lower(F.coalesce(c, F.lit(""))).contains(headers[name].lower()), i))
        return F.get("cells", F.array_min(F.array_compact(spots)))

    found = below.select("file", "sheet", "row_no", *[cell(n).alias(n) for n in headers])
    found = found.filter((F.coalesce("field", F.lit("")) != "") & (F.coalesce("table", F.lit("")) != ""))
    internal, dotted, hashed = field_ids(F.col("table"), F.col("field"))
    return found.withColumns({"internal_table": internal, "internal_id": dotted, "transformer_id": hashed})
