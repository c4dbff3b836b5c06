"""Ranked lexical search, term at a time with a limited number of accumulators.

A first pass reduces every document to its number of terms and its counts of the terms that items ask for; document
frequencies are one aggregation over that table. A second pass scores blocks of it. In a block an item's terms are taken
rarest first. Each adds to accumulators, and makes new ones, until the terms still to come, at their greatest weight in the
block, cannot lift a new document to the ``k``-th partial score (or to the ``k``-th score of the task's earlier blocks). From
then on only existing accumulators are updated, exactly. Tasks return ``k`` documents for each item at most.

The items are a stated query set: a block of them, bounded in number and bytes, is known to all tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablehaul.llm.text import cut_at, stored

K = 20
#: Items whose terms are sent to all tasks at once; further ones are answered by further passes.
ITEMS_AT_ONCE, BYTES_OF_ITEMS = 2000, 8 << 20
DOCS_AT_ONCE, COUNTS_AT_ONCE = 16_384, 2_000_000
BYTES_AT_ONCE = 1 << 20
NO_ID = 2**63 - 1
#: ASCII but letters and digits separates terms; A-Z become small.
FOLDED = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
BLANK = re.compile(b" ")


def term_counts(text: bytes) -> Counter[bytes]:
    counts: Counter[bytes] = Counter()
    for part in cut_at(text.translate(FOLDED), BLANK, BYTES_AT_ONCE):
        counts.update(part.split())
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` and the numbers and counts of the terms in ``numbers`` of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, sizes, terms, tfs, ends = [], [], [], [], [0]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    counts = term_counts(text or b"")
                    if not counts:
                        continue
                    found = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
                    ids.append(doc_id)
                    sizes.append(counts.total())
                    terms += [t for t, _ in found]
                    tfs += [n for _, n in found]
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Block:
    """Counts of some documents turned into lists by term, with the weight that each occurrence adds to a score."""

    def __init__(self, rows: pa.Table, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        ids = rows.column("doc_id")
        self.ids = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        lists = rows.column("terms").combine_chunks()
        doc = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in rows.column("n").to_pylist()], np.int64)
        order = np.argsort(term, kind="stable")
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.docs = doc[order]
        self.adds = (weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc])))[order]
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, term[order], self.adds)

    def best(self, item: list[tuple[int, int]], k: int, floor: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of documents that may be among the ``k`` best; none that scores ``floor`` or more and is, is left out.

        ``item`` holds terms, rarest first, with their number of occurrences; ``totals`` is all zero and is left so.
        """
        lists = [(self.starts[t], self.starts[t + 1], n, int(self.most[t]) * n) for t, n in item if self.starts[t] < self.starts[t + 1]]
        open_until = sum(bound for *_, bound in lists)
        reached, survivors = 0, None
        for a, b, n, bound in lists:
            docs, adds = self.docs[a:b], self.adds[a:b] * n
            if survivors is None and (open_until < floor or open_until < reached and open_until < kth(totals, k)):
                survivors = np.flatnonzero(totals)
            if survivors is None:
                totals[docs] += adds
                reached += bound
            elif 8 * len(survivors) < len(docs):
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                hit = docs[at] == survivors
                totals[survivors[hit]] += adds[at[hit]]
            else:
                known = totals[docs] > 0
                totals[docs[known]] += adds[known]
            open_until -= bound
        found = np.flatnonzero(totals)
        scores = totals[found]
        totals[found] = 0
        return first(scores, self.ids[found], k)


def kth(totals: np.ndarray, k: int) -> int:
    """The ``k``-th greatest score, zero if there are fewer."""
    scores = totals[totals > 0]
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, of equal ones those with smaller ids."""
    if len(scores) > k:
        near = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def best_of_tasks(counts: DataFrame, items: list[tuple[int | None, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """For every task and item the ``k`` best documents: ``item`` (number), ``item_id``, ``doc_id``, ``score``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        held, docs, entries = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                docs += part.num_rows
                entries += len(part.column(2).flatten())
                if docs >= DOCS_AT_ONCE or entries >= COUNTS_AT_ONCE:
                    yield Block(pa.Table.from_batches(held), weights, n_docs, n_terms)
                    held, docs, entries = [], 0, 0
        if held:
            yield Block(pa.Table.from_batches(held), weights, n_docs, n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for block in blocks(batches):
            totals = np.zeros(len(block.ids), np.int64)
            for number, (_, terms) in enumerate(items):
                scores, ids = best[number]
                floor = int(scores[-1]) if len(scores) == k else 0
                more, more_ids = block.best(terms, k, floor, totals)
                if len(more):
                    best[number] = first(np.concatenate([scores, more]), np.concatenate([ids, more_ids]), k)
        for low in range(0, len(items), 500):
            sizes = [len(scores) for scores, _ in best[low : low + 500]]
            numbers = np.repeat(np.arange(low, low + len(sizes)), sizes)
            scores, ids = (np.concatenate([b[i] for b in best[low : low + 500]]) for i in (0, 1))
            item_ids = pa.array([items[n][0] for n in numbers.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers), item_ids, pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search_block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int) -> DataFrame:
    """The ``k`` best documents of some items: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    asked = [(item_id, term_counts(text)) for item_id, text in items]
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    counts = stored(counted(docs, numbers), "term-counts")
    whole = counts.agg(F.count("*"), F.sum("n")).first()
    df = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(whole[0], df.get(t, 0)) for t in range(len(numbers))], np.int64)
    listed = [(i, sorted(((numbers[t], n) for t, n in terms.items() if numbers[t] in df), key=lambda x: (df[x[0]], x[0]))) for i, terms in asked]
    found = best_of_tasks(counts, listed, weights, whole[0], whole[1] or 1, k)
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score`` of the ``k`` best documents with a score above zero of every item.

    Equal scores are ordered by ``doc_id``, null ids last; rows that share an id are documents of their own. Null and empty texts
    have no terms: such documents are not counted and such items have no rows. An item that stands twice, with the same id and
    text, is one item. Texts of any length are read whole; empty tables give an empty result; other columns are ignored.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0).distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-size // BYTES_OF_ITEMS))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = (asked.filter(place == b).orderBy("item_id", "text").collect() for b in range(blocks))
    return reduce(DataFrame.union, (search_block(docs, [(r.item_id, r.text.encode()) for r in part], k) for part in parts))
