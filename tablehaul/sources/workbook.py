"""Workbook (xlsx) ingest for a fleet of files: one task parses whole files, Spark spreads them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.functions import parsing, text

_GRID = "file string, sheet string, sheet_no int, row_no int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    number = 0
    for c in ref:
        if c.isdigit():
            break
        number = number * 26 + ord(c) - 64
    return number


def _cell_text(cell, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    value = cell.findtext(f"{_MAIN}v")
    return shared[int(value)] if value is not None and cell.get("t") == "s" else value


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet number, row number, cells) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root]
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        parts = {link.get("Id"): link.get("Target").lstrip("/") for link in links}
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        for sheet_no, sheet in enumerate(sheets):
            part = parts[sheet.get(_REL)]
            with book.open(part if part.startswith("xl/") else f"xl/{part}") as stream:
                row_no = 0
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    row_no = int(row.get("r") or row_no + 1)
                    cells: list[str | None] = []
                    for cell in row:
                        at = _column_number(cell.get("r")) if cell.get("r") else len(cells) + 1
                        cells.extend([None] * (at - len(cells)))
                        cells[at - 1] = _cell_text(cell, shared)
                    yield sheet.get("name"), sheet_no, row_no, cells
                    row.clear()


def read_workbooks(spark: SparkSession, paths: str | list[str], batch: int = 5000) -> DataFrame:
    """All rows of all sheets as text cells, emitted in bounded batches."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "sheet", "sheet_no", "row_no", "cells"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                for row in workbook_rows(content):
                    rows.append((path, *row))
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, _GRID)


def first_filled_sheet(grid: DataFrame) -> DataFrame:
    """Rows of each file's first sheet with content, from its first filled row (the header) on.

    Columns: file, sheet, row_no, header, cells.
    """
    filled = grid.filter(F.exists("cells", lambda c: ~text.is_blank(c)))
    start = filled.groupBy("file").agg(
        F.min_by(F.struct("sheet_no", "row_no", "cells"), F.struct("sheet_no", "row_no")).alias("h")
    )
    rows = grid.join(start, "file").filter((F.col("sheet_no") == F.col("h.sheet_no")) & (F.col("row_no") > F.col("h.row_no")))
    return rows.select("file", "sheet", "row_no", F.transform("h.cells", text.clean).alias("header"), "cells")


def long_cells(rows: DataFrame) -> DataFrame:
    """(file, row_no, ordinal, field_name, value) of named columns; positions stay as in the sheet."""
    spread = rows.select("file", "row_no", "cells", F.posexplode("header").alias("at", "field_name"))
    return spread.filter(F.col("field_name") != "").select(
        "file", "row_no", (F.col("at") + 1).alias("ordinal"), "field_name", text.clean(F.get("cells", F.col("at"))).alias("value")
    )


def workbook_catalogue(rows: DataFrame) -> DataFrame:
    """Source catalogue of every workbook: first example and nullability per column."""
    filled = F.col("value") != ""
    example = F.min_by(F.when(filled, F.col("value")), F.when(filled, F.col("row_no")))
    return long_cells(rows).groupBy("file", "ordinal", "field_name").agg(
        example.alias("example"), (example.isNull() | (F.count_if(~filled) > 0)).alias("nullable")
    ).withColumn("dtype", F.lit("string"))


# Accepted headers per dictionary column, preferred first.
ALIASES = {
    "sheet": ["Sheet Name", "sheet_name", "SheetName"],
    "field_group": ["Group Name", "field_group", "Group", "FieldGroup"],
    "description": ["Field Description", "field_description", "Description"],
    "importance": ["Importance", "importance", "Mandatory"],
    "data_type": ["Type", "data_type", "DataType", "Data Type"],
    "length": ["Length", "length"],
    "decimal": ["Decimal", "decimal", "Decimals"],
    "table": ["SAP Structure", "sap_table", "sap_structure", "Table"],
    "field_name": ["SAP Field", "sap_field", "Field"],
}


def alias_dictionary(rows: DataFrame, variant: Column) -> DataFrame:
    """Target catalogue from a workbook whose headers may vary; exact aliases before other case.

    Files that lack the description or the field column yield nothing; see ``unusable_files``.
    """
    def spot(name: str) -> Column:
        exact = [F.array_position("header", a) for a in ALIASES[name]]
        lowered = F.transform("header", F.lower)
        loose = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(lowered, a.lower()), F.lit(0)) for a in ALIASES[name]])))
        return F.coalesce(*[F.nullif(e, F.lit(0)) for e in exact], loose).cast("int")

    def cell(name: str, default: Column) -> Column:
        value = text.clean(F.get("cells", spot(name) - 1))
        return F.when(spot(name).isNotNull(), value).otherwise(default)

    usable = rows.filter(spot("description").isNotNull() & spot("field_name").isNotNull())
    mandatory = parsing.is_mandatory_strict(cell("importance", F.lit("")))
    group = F.lower(cell("field_group", F.lit("")))
    decimal = cell("decimal", F.lit(""))
    return usable.select(
        "file", "row_no", cell("field_name", F.lit("")).alias("field_name"), cell("description", F.lit("")).alias("description"),
        cell("table", variant).alias("table"), mandatory.alias("is_mandatory"),
        F.when(group == "", "default").otherwise(group).alias("field_group"), (mandatory & (group == "key")).alias("is_key"),
        cell("sheet", F.lit("Field List")).alias("sheet"), cell("data_type", F.lit("Text")).alias("data_type"),
        parsing.parse_length_lenient(cell("length", F.lit(""))).alias("length"),
        F.when(~decimal.isin("", "None"), decimal).alias("decimal"),
    )


def unusable_files(rows: DataFrame) -> DataFrame:
    """Files whose header lacks the description or the field column."""
    has = lambda name: F.exists("header", lambda h: F.lower(h).isin([a.lower() for a in ALIASES[name]]))
    return rows.filter(~(has("description") & has("field_name"))).select("file").distinct()
