"""Vector code compression: product codebooks fitted and applied over Hilbert-sorted flat blocks.

A vector is cut into equal parts; each part position has a codebook of entries. A task takes some thousand vectors and lays the
parts of each position out along a Hilbert curve in flat blocks, with the smallest and largest component and the sum of
every block. These blocks are written once. A round measures boxes against entries: entries whose least distance to a box
exceeds the least of the greatest distances can win no vector in it, nor can one that is farther than the safest entry at
every corner; the others are the block's shortlist. A block with one
entry left gives its stored sum without a look at its vectors; the others are decided by an exact integer kernel over the
shortlist. What leaves a task in a round is one sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import stored, unused

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a flat block; vectors and components that a task sorts together.
BLOCK, VECTORS_AT_ONCE, COMPONENTS_AT_ONCE = 32, 16_384, 4_000_000
#: Components below this fit the integer kernel; larger ones are computed with Python's integers, and end at ``MOST``.
NARROW, MOST = 1 << 24, 1 << 62
#: Positions that the curve orders (those with the widest range) and bits of its key.
CURVE_POSITIONS, CURVE_BITS = 12, 60
LARGEST = 2**63 - 1
#: Tables of sums by label up to this size go to all tasks.
MOST_SENT = 100_000

BLOCKS = "ids array<long>, labels array<{label}>, wide boolean, {data}"
DATA = ["part_values", "part_orders", "box_low", "box_high", "box_sums"]


def hilbert(values: np.ndarray) -> np.ndarray:
    """Place of every row along a Hilbert curve through the box of all rows (Skilling's transpose form)."""
    points = values.astype(float)
    low, span = points.min(axis=0), np.ptp(points, axis=0)
    used = np.argsort(-span, kind="stable")[:CURVE_POSITIONS]
    bits = CURVE_BITS // len(used)
    scaled = (points[:, used] - low[used]) / np.where(span[used] > 0, span[used], 1) * ((1 << bits) - 1)
    return curve_place([c for c in scaled.astype(np.int64).T], bits)


def curve_place(axes: list[np.ndarray], bits: int) -> np.ndarray:
    axes = [a.copy() for a in axes]
    for bit in reversed(range(1, bits)):
        below = (1 << bit) - 1
        for axis in axes:
            is_set = (axis >> bit & 1).astype(bool)
            swap = np.where(is_set, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(is_set, below, swap)
            axis ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turned = np.zeros_like(axes[0])
    for bit in reversed(range(1, bits)):
        turned ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    place = np.zeros_like(axes[0])
    for bit in reversed(range(bits)):
        for axis in axes:
            place = place << 1 | ((axis ^ turned) >> bit & 1)
    return place


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` of the rows whose vector can be coded."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    vector: Column = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
    return rows.filter("vector IS NOT NULL").filter(~F.exists("vector", bad)).filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))


def components(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -float(MOST), float(MOST)).astype(np.int64)


def starts_of(n: int) -> np.ndarray:
    return np.arange(0, n, BLOCK)


def flat_blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """One row for each set of vectors that a task sorted: ids, labels and, by part position, sorted values with their boxes."""
    label = rows.schema["label"].dataType.simpleString()
    schema = BLOCKS.format(label=label, data=", ".join(f"{d} array<binary>" for d in DATA))
    at_once = max(BLOCK, min(VECTORS_AT_ONCE, COMPONENTS_AT_ONCE // size))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        found = components(table.column("vector").combine_chunks().flatten().to_numpy().reshape(n, size))
        wide = bool(np.abs(found).max() >= NARROW)
        data: list[list[bytes]] = [[] for _ in DATA]
        for part in np.split(found, parts, axis=1):
            order = np.argsort(hilbert(part), kind="stable")
            ordered, at = part[order], starts_of(n)
            sums = np.add.reduceat(ordered, at, axis=0)  # not used where wide
            arrays = (ordered.astype("<i8" if wide else "<i4"), order.astype("<i4"), np.minimum.reduceat(ordered, at, axis=0), np.maximum.reduceat(ordered, at, axis=0), sums)
            for column, array in zip(data, arrays, strict=True):
                column.append(array.tobytes())
        one = pa.array([0, n], pa.int32())
        ids, labels = (pa.ListArray.from_arrays(one, table.column(c).combine_chunks()) for c in ("vec_id", "label"))
        return pa.RecordBatch.from_arrays([ids, labels, pa.array([wide]), *(pa.array([d], pa.list_(pa.binary())) for d in data)], ["ids", "labels", "wide", *DATA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(start, BLOCK))
                n += held[-1].num_rows
                if n >= at_once:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, schema)


class Part:
    """The flat blocks of one part position of one row."""

    def __init__(self, n: int, width: int, wide: bool, values: bytes, order: bytes, low: bytes, high: bytes, sums: bytes) -> None:
        self.values = np.frombuffer(values, "<i8" if wide else "<i4").reshape(n, width).astype(object if wide else np.int64)
        self.order = np.frombuffer(order, "<i4")
        self.low, self.high, self.sums = (np.frombuffer(x, np.int64).reshape(-1, width) for x in (low, high, sums))
        self.starts = starts_of(n)
        self.wide = wide
        if wide:
            self.low, self.high = self.low.astype(object), self.high.astype(object)
            self.sums = np.add.reduceat(self.values, self.starts, axis=0)

    def shortlists(self, book: np.ndarray) -> np.ndarray:
        """For every block and entry: may the entry be nearest to a vector of the block?"""
        below, above = self.low[:, None, :] - book, book - self.high[:, None, :]
        outside = np.maximum(np.maximum(below, above), 0)
        least = (outside * outside).sum(axis=2)
        across = np.maximum(abs(below), abs(above))
        most = (across * across).sum(axis=2)
        # against the entry that is never far from the box: at which corner does another one come off best?
        sure = book[most.argmin(axis=1)]
        apart = book - sure[:, None, :]
        corner = np.where(apart > 0, self.high[:, None, :], self.low[:, None, :])
        gain = (sure * sure).sum(axis=1)[:, None] - (book * book).sum(axis=1) + 2 * (corner * apart).sum(axis=2)
        return (least <= most.min(axis=1)[:, None]) & (gain >= 0)

    def nearest(self, start: int, book: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries of a block's vectors and their squared distances; of equal distances the lower index wins."""
        gap = self.values[start : start + BLOCK, None, :] - book[listed]
        squared = (gap * gap).sum(axis=2)
        chosen = squared.argmin(axis=1)
        return listed[chosen], squared[np.arange(len(chosen)), chosen]

    def sum_into(self, book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> int:
        """Adds every vector to its nearest entry; gives the number of blocks that were decided by their box alone."""
        alone = 0
        for number, short in enumerate(self.shortlists(book)):
            start, listed = self.starts[number], np.flatnonzero(short)
            if len(listed) == 1:
                alone += 1
                counts[listed[0]] += min(BLOCK, len(self.values) - start)
                sums[listed[0]] += self.sums[number]
            else:
                chosen, _ = self.nearest(start, book, listed)
                np.add.at(counts, chosen, 1)
                np.add.at(sums, chosen, self.values[start : start + BLOCK])
        return alone

    def coded(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every vector, in the order of the ids."""
        codes, errors = np.zeros(len(self.values), np.uint8), np.zeros(len(self.values), self.values.dtype)
        for number, short in enumerate(self.shortlists(book)):
            start = self.starts[number]
            place = self.order[start : start + BLOCK]
            codes[place], errors[place] = self.nearest(start, book, np.flatnonzero(short))
        return codes, errors


def parts_of(row: dict, width: int) -> Iterator[Part]:
    for data in zip(*(row[d] for d in DATA), strict=True):
        yield Part(len(row["ids"]), width, row["wide"], *data)


def as_arrays(books: list[list[list[int]]]) -> list[np.ndarray]:
    """Codebooks as integer arrays; entries beyond the kernel's range stay Python integers."""
    largest = max(abs(x) for book in books for entry in book for x in entry)
    return [np.array(book, np.int64 if largest < NARROW else object) for book in books]


def improved(blocks: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """A round: every entry becomes the floor of the mean of its parts; entries without parts stay."""
    width = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = as_arrays(books)
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), object) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                for p, part in enumerate(parts_of(batch.slice(i, 1).to_pylist()[0], width)):
                    own = np.zeros((len(arrays[p]), width), part.values.dtype)
                    part.sum_into(arrays[p], counts[p], own)
                    sums[p] += own
        used = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        columns = [[p for p, _ in used], [e for _, e in used], [int(counts[p][e]) for p, e in used], [[str(x) for x in sums[p][e]] for p, e in used]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

    of_tasks = blocks.mapInArrow(run, "part int, entry int, n long, sums array<string>")
    totals = of_tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width))).alias("sums"))
    new = [[list(entry) for entry in book] for book in books]
    for r in totals.collect():  # one row for each entry of a codebook
        new[r.part][r.entry] = [int(x) // r.n for x in r.sums]
    return new


def coded(blocks: DataFrame, books: list[list[list[int]]], label: str) -> DataFrame:
    """``vec_id``, ``label``, ``code`` (a byte for each part) and ``error`` of every vector."""
    width = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = as_arrays(books)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                found = [part.coded(arrays[p]) for p, part in enumerate(parts_of(one.to_pylist()[0], width))]
                codes = np.stack([c for c, _ in found], axis=1)
                errors = sum(e for _, e in found)
                if errors.dtype == object:
                    errors = np.array([min(int(e), LARGEST) for e in errors], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0).flatten(), one.column(1).flatten(), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors.astype(np.int64))],
                    ["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code binary, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of all vectors (see ``coded``) and the codebooks: integers by part, entry and position.

    Components are ``floor(256 * x)``. Rows whose vector is null or holds null or non-finite components are dropped; so are
    vectors that cannot be cut into equal parts, and those whose length differs from that of the vector with the smallest
    id. The first codebook holds the parts of the ``entries`` (256 at most) smallest ids, null ids last, of equal ids the smaller
    vectors first; with fewer vectors it is smaller. Components beyond 2^62 count as 2^62 and errors end at 2^63 - 1. Repeated
    rows give repeated rows, an empty table an empty result without codebooks; further columns are ignored.
    """
    rows = usable(vectors, parts)
    label = rows.schema["label"].dataType.simpleString()
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not head:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    size = len(head[0].vector)
    rows = rows.filter(F.size("vector") == size)
    if any(len(r.vector) != size for r in head):
        head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    first = components(np.array([r.vector for r in head]))
    books = [part.tolist() for part in np.split(first, parts, axis=1)]
    blocks = stored(flat_blocks(rows, size, parts), "vector-blocks")
    for _ in range(rounds):
        books = improved(blocks, books)
    return coded(blocks, books, label), books


def digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over all rows with an equal label; null labels belong together."""
    name, total = unused("label_", codes), F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stored(codes.groupBy("label").agg(F.least(total, F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", name)
    small = F.broadcast(sums) if sums.count() <= MOST_SENT else sums
    return codes.join(small, F.col("label").eqNullSafe(F.col(name))).drop(name)
