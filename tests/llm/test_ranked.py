"""Ranked search against a plain loop over all documents, its stopping rule, and edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablehaul.llm import ranked

DOCS = "doc_id long, text string, score long, item string"
ITEMS = "item_id long, text string, doc_id long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    """Every document against every item, as the rule is stated."""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    rows = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(rows)


def some_rows(seed, n_docs=150, n_items=12):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(120)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[7][1]) for i in range(30)]  # copies: equal scores
    docs += [(500, None), (501, ""), (502, " .,! "), (3, "C1 R5 é r5É"), (None, docs[7][1]), (503, "r1 " * 500)]
    items = [(i, text(rng.randint(1, 15))) for i in range(n_items)] + [(90, docs[7][1]), (91, None), (92, "?"), (93, "unknown terms"), (94, "r5É R5 r5"), (0, "c0 c0 c1")]
    return docs, [*items, items[0]]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_plain_loop(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(ranked, "DOCS_AT_ONCE", 20)
        monkeypatch.setattr(ranked, "BYTES_AT_ONCE", 30)
    if seed == 2:
        monkeypatch.setattr(ranked, "ITEMS_AT_ONCE", 5)
    docs, items = some_rows(seed)
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = Counter(tuple(r) for r in ranked.search(given, asked).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items)


def test_no_accumulators_are_made_once_the_rest_cannot_reach_the_kth_score():
    n = 400
    held = [[0, 1] if i < 30 else [1] for i in range(n)]  # a rare term in 30 documents, a common one in all
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([t for h in held for t in h], pa.int32()))
    ones = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ones(offsets[-1]), pa.int32()))
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "n": pa.array([10] * n, pa.int64()), "terms": lists, "tfs": ones})
    block = ranked.Block(rows, np.array([2000, 5]), n, 10 * n)

    class Watched(np.ndarray):
        made: set = set()

        def __setitem__(self, at, value):
            Watched.made |= set(np.atleast_1d(at).tolist())
            super().__setitem__(at, value)

    totals = np.zeros(n, np.int64).view(Watched)
    scores, ids = block.best([(0, 1), (1, 1)], 20, 0, totals)
    assert ids.tolist() == list(range(20)) and Watched.made == set(range(30))
    both = int(block.adds[block.docs == 0].sum())
    assert scores.tolist() == [both] * 20  # survivors go on exactly
    assert not np.asarray(totals).any()
    Watched.made = set()
    assert block.best([(0, 1), (1, 1)], 20, both + 1, totals)[0].tolist() == [] and Watched.made == set()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert ranked.search(docs, items).count() == 0
    assert ranked.search(spark.createDataFrame([(1, "a", 1, "x")], DOCS), items.limit(0)).count() == 0
    assert ranked.search(spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 1, "x")], DOCS), items).count() == 1
