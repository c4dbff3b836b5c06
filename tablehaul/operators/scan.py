"""Values carried down a sorted table across range partitions: the merged cells of sheets of any length.

Rows are range-partitioned and sorted once. Every partition tells what is still open at its end (one small row); these states are
chained over the partitions, and every partition is then filled from the state it begins with. A value that reaches over
millions of rows is one entry of a state, never a row for each of them, and a large sheet is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.session import cut_lineage

#: What is open: column, row of the merged cell, last row it reaches, its value.
OPEN = "array<struct<col_no:long,from_row:long,until:long,value:string>>"
STATE = f"part int, first_file string, first_sheet string, file string, sheet string, row_no long, open {OPEN}"
ROW = "file string, sheet string, row_no long, cells array<string>"
State = list[tuple[int, int, int, str]]


class Filler:
    """The merged cells that are open as the rows of a sheet pass by."""

    def __init__(self, sheet: tuple | None = None, state: State = ()) -> None:
        self.sheet = sheet
        self.open: dict[int, State] = {}
        for entry in state:
            self.open.setdefault(entry[0], []).append(entry)

    def move(self, sheet: tuple, row: int) -> None:
        """Goes to a row: merges that end before it are closed."""
        if sheet != self.sheet:
            self.sheet, self.open = sheet, {}
        for col, entries in list(self.open.items()):
            left = [e for e in entries if e[2] >= row]
            if left:
                self.open[col] = left
            else:
                del self.open[col]

    def add(self, row: int, cells: list[tuple[int, str | None, int]]) -> None:
        for col, value, down in cells:
            if down > 0 and value is not None:
                self.open.setdefault(col, []).append((col, row, row + down, value))

    def filled(self, cells: list[tuple[int, str | None, int]], width: int) -> list[str | None]:
        """Values by column: a row's own cell wins, then the latest merged cell above that reaches it."""
        out: list[str | None] = [None] * width
        for col, entries in self.open.items():
            out[col - 1] = max(entries, key=lambda e: e[1])[3]
        for col, value, _ in cells:
            out[col - 1] = value
        return out

    def state(self) -> State:
        return sorted(e for entries in self.open.values() for e in entries)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, int, list[tuple[int, str | None, int]]]]:
    """Partition, sheet, row number and cells of every row, from sorted cells."""
    current, cells = None, []
    for batch in batches:
        for part, file, sheet, row, col, value, down in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current != (part, file, sheet, row):
                if current is not None:
                    yield current[0], current[1:3], current[3], cells
                current, cells = (part, file, sheet, row), []
            cells.append((col, value, down))
    if current is not None:
        yield current[0], current[1:3], current[3], cells


def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last sheet of the partition, its last row, and what is open there."""
    filler, first, part, row = Filler(), None, None, None
    for part, sheet, row, cells in rows_of(batches):
        first = first or sheet
        filler.move(sheet, row)
        filler.add(row, cells)
    if first is not None:
        state = [dict(zip(("col_no", "from_row", "until", "value"), e, strict=True)) for e in filler.state()]
        kind = pa.list_(pa.struct([("col_no", pa.int64()), ("from_row", pa.int64()), ("until", pa.int64()), ("value", pa.string())]))
        columns = [[part], [first[0]], [first[1]], [filler.sheet[0]], [filler.sheet[1]], [row]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        names = ["part", "first_file", "first_sheet", "file", "sheet", "row_no", "open"]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([state], kind)], names)


def chained(states: list) -> dict[int, tuple[tuple, State]]:
    """For every partition the sheet and state that the ones before it leave open; a state has a column's open merges at most."""
    carried: dict[int, tuple[tuple, State]] = {}
    sheet, state = None, []
    for s in sorted(states, key=lambda s: s.part):
        if state:
            carried[s.part] = (sheet, state)
        own = [tuple(e) for e in s.open]
        last = (s.file, s.sheet)
        if (s.first_file, s.first_sheet) == last == sheet:  # one sheet all through: earlier merges may reach beyond it
            own = sorted([*(e for e in state if e[2] >= s.row_no), *own])
        sheet, state = last, own
    return carried


def fill_merged(cells: DataFrame, width: int) -> DataFrame:
    """``file``, ``sheet``, ``row_no`` and ``cells`` by position, filled down as far as merged cells reach.

    ``cells`` has ``file``, ``sheet``, ``row_no``, ``col_no``, ``value``, ``merge_down``; only rows that have a cell are given. The
    sorted cells are stored, because range bounds are sampled and must not change between both passes.
    """
    order = ["file", "sheet", "row_no"]
    dealt = cells.select(*order, "col_no", "value", F.coalesce("merge_down", F.lit(0)).alias("merge_down")).repartitionByRange(*order)
    sorted_cells = dealt.sortWithinPartitions(*order, "col_no").withColumn("part", F.spark_partition_id())
    kinds = {"row_no": "long", "col_no": "long", "merge_down": "long"}
    named = [F.col(c).cast(kinds.get(c, "string" if c != "part" else "int")).alias(c) for c in ("part", *order, "col_no", "value", "merge_down")]
    placed = cut_lineage(sorted_cells.select(*named))
    carried = chained(placed.mapInArrow(ends, STATE).collect())  # one row for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, out = None, []
        for part, sheet, row, own in rows_of(batches):
            filler = filler or Filler(*carried.get(part, ()))
            filler.move(sheet, row)
            out.append((*sheet, row, filler.filled(own, width)))
            filler.add(row, own)
            if len(out) >= 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return placed.mapInArrow(run, ROW)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "sheet", "row_no", "cells"])
