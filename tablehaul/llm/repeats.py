"""Exact repeats of word windows across a corpus, by fixed-block anchors.

Every document is cut into non-overlapping blocks of ten words: the index. Every rolling ten-word window of every document
probes it. A window of twenty words holds a whole block of each place it occurs at, so the first and all later places of a
repeated window have a probe that met a block (an anchor). Around its anchors, and only there, a text is extended to the
twenty-word windows that hold them; these are compared exactly (96 bits of two hashes) and every place but the first is a
repeat. Overlapping repeats join to maximal ones, and their words are removed.

Probes and windows travel in packed rows by hash bucket. A task first unites equal ones of its own documents, so a passage
that very many documents share sends one row for each task and not one for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import by_key, dealt_by, mix, rolling, stored, text_words, width

WINDOW = 20
#: Words that are handled at once in a task; a longer text is handled alone.
WORDS_AT_ONCE = 400_000
#: Text whose words meet in one bucket, which a task unpacks at once; a partition holds several buckets, one after the other.
BUCKET_BYTES = 6_000_000
#: Bits of the table of documents with anchors that is sent to all tasks (16 MB). More documents only make it less selective.
FILTER_BITS = 1 << 27
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
NO_ID = 2**63 - 1
MOST_KNOWN = 200_000

PACKED = "bucket int, keys binary, extra binary, places binary, ranks binary, texts binary, counts binary"
PACKED_NAMES = ["bucket", "keys", "extra", "places", "ranks", "texts", "counts"]
PACKED_KINDS = [pa.int32(), *[pa.binary()] * 6]
#: A row is a packed set of probes, or of places found, or tells size and digest of one text.
ROW = f"{PACKED}, kind int, rank long, text_key long, n_words long, sha256 string"
ROW_NAMES = [*PACKED_NAMES, "kind", "rank", "text_key", "n_words", "sha256"]
ROW_KINDS = [*PACKED_KINDS, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
PROBES, FOUND, TOLD = 0, 1, 2
PLACES = "rank long, text_key long, at array<int>"


def planes(values: np.ndarray, n_bytes: int | None = None) -> bytes:
    """The lowest bytes of all values, then the next ones, and so on: high bytes are mostly zero and compress to nothing."""
    if not len(values):
        return b""
    grid = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return grid[:, : grid.shape[1] if n_bytes is None else n_bytes].T.tobytes()


def from_planes(data: bytes, kind: type, n_bytes: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    grid = np.frombuffer(data, np.uint8).reshape(n_bytes or size, -1)
    full = np.zeros((grid.shape[1], size), np.uint8)
    full[:, : grid.shape[0]] = grid.T
    return full.view(kind).ravel()


class Words:
    """Hashes of words, remembered while a task runs."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def packed(bucket: np.ndarray, columns: list[bytes | tuple[np.ndarray, int]], doc: np.ndarray, place: np.ndarray, ranks: np.ndarray, texts: np.ndarray, buckets: int) -> list[list]:
    """Packed rows, one per bucket, of entries in any order; ``doc`` indexes ``ranks`` and ``texts``."""
    order = np.lexsort((place, doc, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        own = order[cuts[b] : cuts[b + 1]]
        d, p = doc[own], place[own].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        steps = np.diff(p, prepend=np.int32(0))
        steps[first] = p[first]
        counts = np.diff(np.concatenate([first, [len(d)]])).astype(np.uint32)
        values = [planes(values[own], n_bytes) for values, n_bytes in columns]
        rows.append([b, *values, planes(steps), planes(ranks[d[first]]), planes(texts[d[first]]), planes(counts)])
    return rows


def probes(keys: np.ndarray, extra: np.ndarray, doc: np.ndarray, place: np.ndarray, ranks: np.ndarray, texts: np.ndarray, buckets: int, key_bytes: int) -> pa.RecordBatch:
    """Keys to be compared, dealt out by key."""
    bucket = ((keys >> np.uint64(44)) % np.uint64(buckets)).astype(np.int64)
    return full_rows(packed(bucket, [(keys, key_bytes), (extra, extra.itemsize)], doc, place, ranks, texts, buckets), PROBES)


def text_buckets(ranks: np.ndarray, texts: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every text by its rank and key together, so that copies of one text do not meet in one bucket."""
    return (mix(ranks.view(np.uint64) * np.uint64(BASE) ^ texts.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def found_places(doc: np.ndarray, place: np.ndarray, ranks: np.ndarray, texts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places in texts, dealt out by rank and text."""
    none = np.zeros(len(doc), np.uint8)
    return full_rows(packed(text_buckets(ranks, texts, buckets)[doc], [(none, 0), (none, 0)], doc, place, ranks, texts, buckets), FOUND)


def full_rows(rows: list[list], kind: int) -> pa.RecordBatch:
    batch = batch_of(rows, PACKED_NAMES, PACKED_KINDS)
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, k) for k in ROW_KINDS[8:])], ROW_NAMES)


def told_rows(arrays: list[pa.Array], buckets: int) -> pa.RecordBatch:
    n = len(arrays[0])
    spread = pa.array(text_buckets(arrays[0].to_numpy(), arrays[1].to_numpy(), buckets).astype(np.int32))
    return pa.RecordBatch.from_arrays([spread, *(pa.nulls(n, k) for k in PACKED_KINDS[1:]), pa.array(np.full(n, TOLD, np.int32)), *arrays], ROW_NAMES)


def received(rows: pa.Table, key_bytes: int, extra_kind: type) -> tuple[np.ndarray, ...]:
    """Entries of the packed rows of a bucket: keys, extra, index of document, place; and the documents."""
    parts: list[tuple] = []
    n_docs = 0
    for row in rows.select(PACKED_NAMES[1:]).to_pylist():
        counts = from_planes(row["counts"], np.uint32)
        steps = from_planes(row["places"], np.int32).astype(np.int64)
        total, ends = np.cumsum(steps), np.cumsum(counts)
        before = np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), counts)
        doc = np.repeat(np.arange(n_docs, n_docs + len(counts)), counts)
        n_docs += len(counts)
        keys = from_planes(row["keys"], np.uint64, key_bytes) if key_bytes else np.zeros(0, np.uint64)
        extra = from_planes(row["extra"], extra_kind) if key_bytes else np.zeros(0, extra_kind)
        parts.append((keys, extra, doc, total - before, from_planes(row["ranks"], np.int64), from_planes(row["texts"], np.int64)))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def batch_of(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def of_kind(rows: pa.Table, kind: int, equal: bool = True) -> pa.Table:
    compared = pa.compute.equal if equal else pa.compute.not_equal
    return rows.filter(compared(rows.column("kind"), kind))


def gathered(rows: DataFrame) -> DataFrame:
    """One row per text with all its places that were found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "bucket"):
            _, _, doc, place, ranks, texts = received(group, 0, np.uint8)
            rank, text = ranks[doc], texts[doc]
            order = np.lexsort((place, text, rank))
            rank, text, place = rank[order], text[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (text[1:] != text[:-1])]))
            offsets = pa.array(np.concatenate([first, [len(place)]]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(rank[first]), pa.array(text[first]), lists], ["rank", "text_key", "at"])

    return dealt_by(rows.filter(F.col("kind") == FOUND).select(*PACKED_NAMES), "bucket").mapInArrow(run, PLACES)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of all batches with the words of their text (third column), about ``WORDS_AT_ONCE`` words at a time."""
    held, n = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns), strict=True):
                words = text_words(row[2])
                held.append((*row[:2], words, *row[3:]))
                n += len(words)
                if n >= WORDS_AT_ONCE:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def bucket_count(docs: DataFrame) -> int:
    """So many buckets that one holds the words of about ``BUCKET_BYTES`` of text, whatever the number of partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(width(docs.sparkSession), -(-size // BUCKET_BYTES))


def anchors(docs: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """Places of anchors (packed), and size and digest of every text; see ``ROW``."""
    block = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for chunk in chunks(batches):
            ranks, texts = (np.array([row[i] for row in chunk], np.int64) for i in (0, 1))
            digests = [hashlib.sha256(b" ".join(row[2])).hexdigest() for row in chunk]
            sizes = np.array([len(row[2]) for row in chunk], np.int64)
            yield told_rows([pa.array(ranks), pa.array(texts), pa.array(sizes), pa.array(digests)], buckets)
            words = known.hashes([w for row in chunk for w in row[2]])
            doc = np.repeat(np.arange(len(chunk)), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            valid = np.flatnonzero((place + block <= sizes[doc])) if len(words) else np.zeros(0, np.int64)
            if not len(valid):
                continue
            keys, doc, place = rolling(words, block, BASE)[valid], doc[valid], place[valid]
            order = np.argsort(keys, kind="stable")
            starts, counts = runs_of(keys[order])
            aligned = np.maximum.reduceat((place % block == 0)[order].astype(np.uint8), starts)
            several = np.repeat(counts > 1, counts)
            if several.any():
                own = order[several]
                yield found_places(doc[own], place[own], ranks, texts, buckets)
            one = order[starts]
            flags = aligned | (counts > 1).astype(np.uint8) << 1
            yield probes(keys[one], flags, doc[one], place[one], ranks, texts, buckets, 5)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "bucket"):
            yield from of_kind(group, PROBES, False).to_batches()
            rows = of_kind(group, PROBES)
            if not rows.num_rows:
                continue
            keys, flags, doc, place, ranks, texts = received(rows, 5, np.uint8)
            order = np.argsort(keys, kind="stable")
            starts, counts = runs_of(keys[order])
            joined = np.bitwise_or.reduceat(flags[order], starts)
            found = (joined & 1 == 1) & ((counts > 1) | (joined & 2 == 2))
            own = order[np.repeat(found, counts)]
            own = own[flags[own] & 2 == 0]  # the others were told by their own task
            if len(own):
                yield found_places(doc[own], place[own], ranks, texts, buckets)

    return dealt_by(docs.mapInArrow(probe, ROW), "bucket").mapInArrow(meet, ROW)


def later_windows(anchored: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """For every text the starts of the windows around its anchors whose words also start earlier.

    Rows are rank, text key, text, anchors.
    """
    block = window // 2

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for chunk in chunks(batches):
            ranks, texts = (np.array([row[i] for row in chunk], np.int64) for i in (0, 1))
            parts = []
            for number, (_, _, words, at) in enumerate(chunk):
                n = len(words) - window + 1
                if n <= 0:
                    continue
                # windows that begin up to block - 1 words before an anchor
                edge = np.zeros(n + 1, np.int64)
                at = np.array(at, np.int64)
                np.add.at(edge, np.minimum(np.maximum(at - block + 1, 0), n), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if len(start):
                    hashes = known.hashes(words)
                    second = rolling(mix(hashes + np.uint64(1)), window, SECOND_BASE)
                    parts.append((rolling(hashes, window, BASE)[start], second[start].astype(np.uint32), np.full(len(start), number), start))
            if not parts:
                continue
            keys, second, doc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            first, rest = split_first(keys, second, ranks[doc], start)
            if len(rest):
                yield found_places(doc[rest], start[rest], ranks, texts, buckets)
            yield probes(keys[first], second[first], doc[first], start[first], ranks, texts, buckets, 8)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, "bucket"):
            yield from of_kind(group, PROBES, False).to_batches()
            rows = of_kind(group, PROBES)
            if rows.num_rows:
                keys, second, doc, start, ranks, texts = received(rows, 8, np.uint32)
                _, rest = split_first(keys, second, ranks[doc], start)
                if len(rest):
                    yield found_places(doc[rest], start[rest], ranks, texts, buckets)

    return gathered(dealt_by(anchored.mapInArrow(extend, ROW), "bucket").mapInArrow(decide, ROW))


def split_first(keys: np.ndarray, second: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one first place of every window, and of all places that come later than it (same place: not later)."""
    order = np.lexsort((start, rank, second, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])])
    leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (rank[order] != rank[leader]) | (start[order] != start[leader])
    return order[new], order[~new & later]


def keep_words(marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Size, number of removed words, and digest of the words left of every text; rows are rank, text key, text, starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rank, text_key, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text_words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at)
                edge[starts] += 1
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append([rank, text_key, int(gone.sum()), hashlib.sha256(kept).hexdigest()])
            yield batch_of(out, ["rank", "text_key", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return marked.mapInArrow(run, "rank long, text_key long, n_removed long, kept_sha256 string")


def in_filter(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose (rank, text_key) may be among ``keys``; none that is gets lost. The table of bits has ``bits`` bits."""
    place: Column = F.pmod(F.xxhash64("rank", "text_key"), F.lit(bits))
    table = (
        keys.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    )
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
    named = rows.withColumn("_p", place).withColumn("_own", F.bitmap_bucket_number("_p"))
    return named.join(F.broadcast(table), F.col("_own") == F.col("_bucket")).filter(is_set).select(*rows.columns)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row.

    A word goes if a window of ``window`` words covers it whose words also start earlier: in a smaller ``doc_id``, or at a
    smaller place of the same. Null text has no words. Rows with null ids come after all others and count as one document;
    so do rows that share an id, each judged by its own text. Repeated rows give repeated rows, an empty table an empty
    result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(rank.alias("rank"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    buckets = bucket_count(rows)
    told = stored(anchors(rows, buckets, window), "anchors")
    places = stored(gathered(told), "anchor-places")
    candidates = in_filter(rows, places).repartition(width(docs.sparkSession), "rank", "text_key")
    anchored = candidates.join(places, ["rank", "text_key"]).select("rank", "text_key", "text", "at")
    later = later_windows(anchored, buckets, window)
    marked = candidates.join(later, ["rank", "text_key"]).select("rank", "text_key", "text", "at")
    changed = keep_words(marked, window).dropDuplicates(["rank", "text_key"])
    whole = told.filter(F.col("kind") == TOLD).select("rank", "text_key", "n_words", "sha256")
    return whole.join(changed, ["rank", "text_key"], "left").select(
        F.nullif("rank", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
