"""Delimited data dictionaries, many files at once."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehaul.functions import parsing, text

_GRID = "file string, row_no int, cells array<string>"


def read_delimited_grids(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8", batch: int = 5000) -> DataFrame:
    """Rows of many small delimited files as text cells, in bounded batches.

    For files whose headers differ; a large table with one header belongs in ``read_raw_csv``.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                stream = io.TextIOWrapper(io.BytesIO(content), encoding, newline="")
                rows = []
                for number, cells in enumerate(csv.reader(stream), 1):
                    rows.append((path, number, cells))
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=["file", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "row_no", "cells"])

    return files.mapInPandas(parse, _GRID)


def dictionary_fields(grid: DataFrame) -> DataFrame:
    """One row per described field: file, table, field_name, description, length, is_key, ordinal.

    The first row of a file is its header, matched without regard to case and surrounding blanks,
    so files with other column orders or extra columns can be read together. Blank rows and rows
    without a field name do not count. A file lists the fields of one table, so numbering within
    a file is a small group.
    """
    header = grid.filter(F.col("row_no") == 1).select(
        "file", F.transform("cells", lambda c: F.lower(text.clean(c))).alias("header")
    )
    data = grid.filter((F.col("row_no") > 1) & F.exists("cells", lambda c: c != "")).join(header, "file")

    def cell(name: str):
        at = F.array_position("header", name).cast("int")
        return text.clean(F.when(at > 0, F.get("cells", at - 1)))

    kind, words = cell("data type"), cell("field text")
    extra = F.when((words != "") & (words != kind), words)
    description = (
        F.when(extra.isNull(), F.nullif(kind, F.lit("")))
        .when(kind != "", F.concat(kind, F.lit(" ("), extra, F.lit(")")))
        .otherwise(extra)
    )
    fields = data.select(
        "file", "row_no", cell("table name").alias("table"), cell("field name").alias("field_name"),
        description.alias("description"), parsing.parse_length(cell("length")).alias("length"),
        parsing.is_marked(cell("is key")).alias("is_key"),
    ).filter(F.col("field_name") != "")
    order = Window.partitionBy("file").orderBy("row_no")
    return fields.select(
        "file", "table", "field_name", "description", F.lit("string").alias("dtype"), "length", "is_key",
        (~F.col("is_key")).alias("nullable"), F.row_number().over(order).alias("ordinal"),
    )


def read_dictionary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return dictionary_fields(read_delimited_grids(spark, paths))
