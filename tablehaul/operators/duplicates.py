"""Rows whose key is empty or occurs more than once, when few do: two passes, of which the first moves a few bytes a row.

Every key hashes to one of ``SPREAD`` positions for each row of the table. A task sorts the positions of its rows and sends
them as gaps, cut into ranges; a position that comes twice is sent twice at most, however many rows share it. Where a range
meets, positions met twice are suspects. A table of bits of the suspects then goes to all tasks, and only rows that hit it
are shuffled for the exact check. Hashes that agree by chance cost a shuffled row, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.functions.text import is_blank
from tablehaul.operators.project import quoted
from tablehaul.operators.validate import rows_with_bad_key
from tablehaul.session import cut_lineage

SPREAD = 64
#: Positions that a task sorts together, and positions that meet in one range on average.
AT_ONCE, IN_RANGE = 2_000_000, 1_000_000
#: Least and greatest size of the table of bits (128 MB). Beyond that it only lets more rows through.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
PACKED = "part int, n int, gaps binary"


def as_gaps(positions: np.ndarray) -> bytes:
    """Sorted positions as differences, byte by byte of all: high bytes are zero and compress to nothing."""
    gaps = np.diff(positions, prepend=0).astype("<u8")
    used = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return gaps.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def from_gaps(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, : len(planes)] = planes.T
    return np.cumsum(full.view("<u8").ravel().astype(np.int64))


def at_most_twice(positions: np.ndarray) -> np.ndarray:
    ordered = np.sort(positions)
    third = np.zeros(len(ordered), bool)
    third[2:] = (ordered[2:] == ordered[1:-1]) & (ordered[2:] == ordered[:-2])
    return ordered[~third]


def packed(positions: DataFrame, span: int) -> DataFrame:
    """Gaps of the positions of a task's rows, by range of ``span`` positions."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        ordered = at_most_twice(np.concatenate(held))
        part = ordered // span
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        pairs = list(zip(cuts, cuts[1:], strict=False))
        parts = [int(part[a]) for a, _ in pairs]
        gaps = [as_gaps(ordered[a:b] - p * span) for (a, b), p in zip(pairs, parts, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([b - a for a, b in pairs], pa.int32()), pa.array(gaps, pa.binary())], ["part", "n", "gaps"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
                n += batch.num_rows
            if n >= AT_ONCE:
                yield rows(held)
                held, n = [], 0
        if held:
            yield rows(held)

    return positions.mapInArrow(run, PACKED)


def suspects(df: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Positions that keys of more than one row have, as a stored table ``at``, and the position of a row's key."""
    total = max(1, df.count())
    at = F.pmod(F.xxhash64(*[quoted(k) for k in keys]), F.lit(SPREAD * total))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(SPREAD * total, max(width, total // IN_RANGE)))
    span = -(-SPREAD * total // parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def twice(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
            ordered = np.sort(np.concatenate(held))
            found = np.unique(ordered[1:][ordered[1:] == ordered[:-1]]) + part * span
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["at"])

        current, held = None, []
        for batch in batches:
            for part, n, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != current and held:
                    yield twice(current, held)
                    held = []
                current = part
                held.append(from_gaps(gaps, n))
        if held:
            yield twice(current, held)

    dealt = packed(df.select(at.alias("at")), span).repartitionById(width, F.pmod(F.col("part"), F.lit(width)))
    return cut_lineage(dealt.sortWithinPartitions("part").mapInArrow(meet, "at long")), at


def possible(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key may occur twice, and few others."""
    found, at = suspects(df, keys)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * found.count()).bit_length()))
    place = F.pmod(F.col("at"), F.lit(bits))
    table = (
        found.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("__bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("__bits"))
    )
    own = F.pmod(at, F.lit(bits))
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
    # at most MOST_BITS bits
    return df.join(F.broadcast(table), (F.bitmap_bucket_number(own) == F.col("__bucket")) & is_set, "left_semi")


def rows_with_repeated_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``validate.rows_with_bad_key``: keys that are empty or occur more than once. Null keys equal each other."""
    empty = reduce(Column.__or__, [is_blank(quoted(k)) for k in keys])
    filled = df.filter(~empty)
    return rows_with_bad_key(possible(filled, keys), keys).unionByName(df.filter(empty))
