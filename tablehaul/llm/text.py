"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.session import new_output

#: White space that separates words: space and the ASCII controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def text_words(text: str | None) -> list[bytes]:
    """The same words inside a task, as UTF-8: ``bytes.split`` knows exactly these blanks."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def cut_at(text: bytes, blank: re.Pattern[bytes], size: int) -> Iterator[bytes]:
    """Slices of about ``size`` bytes that end at a blank; a run without blanks stays whole."""
    at = 0
    while at < len(text):
        found = blank.search(text, at + size) if len(text) - at > size else None
        upto = found.end() if found else len(text)
        yield text[at:upto]
        at = upto


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit of a 64-bit value over the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` values, by doubling window lengths."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, offset, total = 1, 0, None
    power, block = base & (2**64 - 1), hashes
    left = width
    while left:
        if left & 1:
            part = block[offset : offset + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            offset += done
        left >>= 1
        if left:
            block = block[: len(block) - done] * np.uint64(power) + block[done:]
            power = power * power & (2**64 - 1)
            done *= 2
    return mix(total)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Parts of a few rows each, so that what is made of them stays small; Spark's own batches hold up to 10,000 rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``key``, one table per key value."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and keys[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back: it is computed once and survives executors."""
    path = new_output(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_by(df: DataFrame, bucket: str, *order: str | Column) -> DataFrame:
    """Rows of a bucket in one partition, sorted by bucket and ``order``; buckets go round the partitions, none is left out by chance."""
    n = width(df.sparkSession)
    return df.repartitionById(n, F.pmod(F.col(bucket), F.lit(n))).sortWithinPartitions(bucket, *order)


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which is set to suit the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


#: Ids (8 bytes each) up to which a list of rows to leave out goes to all tasks; a longer one is joined by a shuffle.
MOST_IDS_SENT = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is not among ``ids`` (one column); null is an id like others."""
    name = unused("left_out", docs)
    listed = stored(ids.select(F.col(ids.columns[0]).cast("long").alias(name)), "left-out")
    if listed.count() <= MOST_IDS_SENT:
        listed = F.broadcast(listed)
    return docs.join(listed, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


class Remembered:
    """Values of keys, made once and kept in two generations: a full one becomes the old one, so frequent keys stay.

    ``make`` gets a list of new keys and returns their values.
    """

    def __init__(self, most: int, make: Callable[[list], list]) -> None:
        self.most, self.make = most, make
        self.young: dict = {}
        self.old: dict = {}

    def table(self, keys: list) -> dict:
        """A dictionary that holds all of ``keys``; valid until the next call."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for key in set(keys).difference(young):
            value = old.get(key)
            if value is None:
                new.append(key)
            else:
                young[key] = value
        young.update(zip(new, self.make(new), strict=True))
        return young
