"""SimHash near-duplicates: fingerprints of word shingles, pigeonhole blocks, Hamming check, connected groups.

64 bits are split into four blocks. Two fingerprints that differ in at most three bits agree in one block at least, so
they meet under that block's key. Equal fingerprints are one node from the start, however many documents share them.
Under a key, a partition holds the fingerprints as a sorted run and passes on only enough verified links to keep them
connected, never all pairs. A key with more fingerprints than ``MOST_UNDER_KEY`` is split again by blocks of the bits
that it leaves open, up to keys that leave nine bits open and so hold 512 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.components import connected
from tablehaul.llm.text import by_key, sliced, stored, width, without_ids

SHINGLE = 3
MOST_BITS = 3
MOST_UNDER_KEY = 8192
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once; bounds the memory for very long texts.
AT_ONCE = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if over half the shingles' XXH64 values (seed 42) have it; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, AT_ONCE):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), 42) for i in range(start, min(n, start + AT_ONCE))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint's 64 bits as a signed long; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bits_at(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1))


def first_keys(fps: DataFrame, blocks: int = 4) -> DataFrame:
    """One key for each block of the fingerprint; ``free`` is the mask of bits that the key leaves open."""
    n = 64 // blocks
    made = []
    for b in range(blocks):
        mask = ((1 << n) - 1) << (n * b)
        made.append(F.struct(F.xxhash64(F.lit(b), bits_at(F.col("fp"), n * b, n)).alias("key"), F.lit(signed(~mask)).alias("free")))
    return fps.select("fp", F.inline(F.array(*made)))


def signed(mask: int) -> int:
    mask &= 2**64 - 1
    return mask - 2**64 if mask >> 63 else mask


def split_keys(keyed: DataFrame, parts: int, agree: int) -> DataFrame:
    """Splits crowded keys: of ``parts`` pieces of the open bits, pairs agree in at least ``agree``.

    ``agree`` must not exceed ``parts - MOST_BITS``. The open bits of a key depend on ``free`` only, of which there are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            key = batch.column(1).to_numpy().view(np.uint64)
            free = batch.column(2).to_numpy().view(np.uint64)
            for mask in np.unique(free):
                at = np.flatnonzero(free == mask)
                places = [i for i in range(64) if int(mask) >> i & 1]
                pieces = [sum(1 << i for i in p.tolist()) for p in np.array_split(np.array(places), parts)]
                for number, chosen in enumerate(combinations(range(parts), agree)):
                    held = sum(pieces[c] for c in chosen)
                    salt = np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
                    mixed = (fp[at] & np.uint64(held)) * np.uint64(0xC4CEB9FE1A85EC53)
                    new = (key[at] ^ salt) * np.uint64(0xFF51AFD7ED558CCD) + (mixed ^ (mixed >> np.uint64(29)))
                    left = np.full(len(at), int(mask) & ~held, np.uint64)
                    arrays = [pa.array(x.view(np.int64)) for x in (fp[at], new, left)]
                    yield pa.RecordBatch.from_arrays(arrays, ["fp", "key", "free"])

    return keyed.mapInArrow(run, "fp long, key long, free long")


def spanning(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links of at most ``most`` bits that connect all that are connected among these fingerprints, one per node at most.

    Each step takes a reached fingerprint and finds the ones it reaches among those not yet reached.
    """
    left, right, rest = [], [], fps
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= most
            if near.any():
                found = rest[near]
                left += [int(one)] * len(found)
                right += found.tolist()
                queue += list(found)
                rest = rest[~near]
        queue = []
    return left, right


def links_under_keys(keyed: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Verified links ``a``, ``b`` between fingerprints that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "key"):
            if group.num_rows < 2:
                continue
            fps = np.unique(group.column("fp").to_numpy().view(np.uint64))
            if len(fps) == 2 and int(fps[0] ^ fps[1]).bit_count() > most:
                continue
            left, right = spanning(fps, most)
            if left:
                a, b = np.array(left, np.uint64), np.array(right, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = keyed.select("fp", "key").repartition(width(keyed.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, most_under_key: int = MOST_UNDER_KEY) -> DataFrame:
    """Enough links to connect all distinct fingerprints that are connected by steps of at most three bits."""
    found, keyed = None, first_keys(fps)
    for parts, agree in ((4, 1), (12, 9), (0, 0)):
        if parts:
            crowded = keyed.groupBy("key").count().filter(F.col("count") > most_under_key).select("key")
            crowded = stored(crowded, "crowded-keys")
            one = links_under_keys(keyed.join(crowded, "key", "left_anti"))
        else:
            one = links_under_keys(keyed)
        found = one if found is None else found.union(one)
        if not parts or crowded.isEmpty():
            break
        keyed = split_keys(keyed.join(crowded, "key", "left_semi").select("fp", "key", "free"), parts, agree)
    return found


def groups(docs: DataFrame, most_under_key: int = MOST_UNDER_KEY, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``doc_id`` that links lead to.

    Documents without words have fingerprint zero and are linked like others. Rows with a null ``doc_id`` are linked too;
    they never name a group unless it has no other documents (then its id is null). Repeated rows give repeated rows, an
    empty table an empty result; other columns are ignored.
    """
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    edges = stored(links(nodes.select("fp"), most_under_key), "fingerprint-links")
    labels = connected(edges.select("a", "b"))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(smallest, "label").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(by_fp, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Of repeated rows with that id, all stay."""
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = groups(docs).groupBy("doc_id").agg(F.bool_or(is_first).alias("stays")).filter("NOT stays")
    return without_ids(docs, gone.select("doc_id"))
