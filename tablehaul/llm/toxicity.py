"""Toxicity by a learnt lexicon: misspellings through Levenshtein automata on a trie, and scores of context windows.

The lexicon is learnt from labelled documents: words, and beginnings that many words share, that occur in many different
contexts of toxic documents and almost never in clean ones. Copies of one document share their contexts, so they count once.
A word of a text is matched by walking the lexicon's trie with the word's Levenshtein automaton, both advanced together.
A hit inside quotation marks or after a word of reporting weighs little; the densest window and the sum make the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.text import Remembered, sliced, stored

#: At most so many labelled documents of each kind are learnt from: those with the smallest hashes of their ids.
MOST_TOXIC, MOST_CLEAN = 3000, 4000
#: Terms need so many different contexts in toxic documents, and at least this share of all their contexts; beginnings of
#: words need more of them, and so many different words.
LEAST_CONTEXTS, LEAST_SHARE = 8, 0.97
LEAST_STEM_CONTEXTS, LEAST_FORMS = 12, 5
DOCS_AT_ONCE = 128
MOST_TERMS = 5000
STEM_LENGTHS = range(4, 9)
#: Words of this length and more may differ from a term by one edit, from the second length on by two.
ONE_EDIT, TWO_EDITS = 5, 10
WINDOW = 25
INEXACT, QUOTED = 0.4, 0.25
#: Words that introduce a quotation, looked for within ``REPORT_SPAN`` words before a hit.
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "called", "word", "term", "sagte", "schrieb", "wort", "dit", "écrit", "mot", "dijo", "escribió", "palabra"}
REPORT_SPAN = 4
WORD = re.compile(r"\w+")
QUOTE = re.compile("[\"“”„«»]")
#: Words of a generation (there are two) whose distances a task remembers.
MOST_CACHED = 60_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def allowed(length: int) -> int:
    """Edits that a word of this length may have."""
    return (length >= ONE_EDIT) + (length >= TWO_EDITS)


class Lexicon:
    """Terms in a trie, and beginnings of words. ``exempt`` are clean words that happen to lie near a term."""

    def __init__(self, words: list[str], stems: list[str], exempt: frozenset[str] = frozenset()) -> None:
        self.root: dict = {}
        self.exempt = exempt
        for term in words:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node["word"] = True
        self.words, self.stems = frozenset(words), frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.parts: dict[str, list[tuple[int, int, int]]] = {}
        for w in words:
            edits = allowed(len(w))
            if edits:
                for i in range(edits + 1):
                    start, end = len(w) * i // (edits + 1), len(w) * (i + 1) // (edits + 1)
                    self.parts.setdefault(w[start:end], []).append((start, len(w), edits))
        places: dict[int, set[int]] = {}
        for part, found in self.parts.items():
            for start, _, edits in found:
                places.setdefault(len(part), set()).update(range(max(0, start - edits), start + edits + 1))
        self.places = [(size, sorted(at)) for size, at in sorted(places.items())]

    def may_be_near(self, word: str) -> bool:
        """Of a term cut into one part more than it may have edits, one part stays whole and about where it was."""
        n = len(word)
        for size, places in self.places:
            for at in places:
                for start, length, edits in self.parts.get(word[at : at + size], ()):
                    if abs(at - start) <= edits and abs(n - length) <= edits:
                        return True
        return False

    def distance(self, word: str) -> int | None:
        """0 for a term or a word with a listed beginning, the edits to the nearest term, or None.

        The automaton of ``word`` is one bit per position and number of edits; it moves with every letter of the trie.
        """
        if word in self.words or any(word[:n] in self.stems for n in self.stem_sizes):
            return 0
        edits = 0 if word in self.exempt else allowed(len(word))
        if not edits or not self.may_be_near(word):
            return None
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i
        final, best = 1 << len(word), None
        walk = [(self.root, 0, [(1 << k + 1) - 1 for k in range(edits + 1)])]
        while walk:
            node, depth, states = walk.pop()
            if "word" in node:
                found = next((k for k, s in enumerate(states[: allowed(depth) + 1]) if s & final), None)
                if found is not None and (best is None or found < best):
                    best = found
            for c, child in node.items():
                if child is True:
                    continue
                at = letters.get(c, 0)
                moved = [(states[0] & at) << 1]
                for k in range(1, edits + 1):
                    moved.append((states[k] & at) << 1 | states[k - 1] | states[k - 1] << 1 | moved[k - 1] << 1)
                if moved[-1]:
                    walk.append((child, depth + 1, moved))
        return best


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    exempt: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-3.0, 5.0, 3.0])

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems, self.exempt)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ np.array(self.weights[1:]), -40, 40)))


def remembered(lexicon: Lexicon) -> Remembered:
    """Edits of words to the nearest term, -1 where there is none, kept while a task runs."""

    def distances(words: list[str]) -> list[int]:
        return [-1 if found is None else found for found in map(lexicon.distance, words)]

    return Remembered(MOST_CACHED, distances)


def features(text: str | None, known: Remembered) -> tuple[float, float, int]:
    """Logarithms of the summed weight of all hits and of the densest window's weight, and the number of hits."""
    lower = text.lower() if text else ""
    words = set(WORD.findall(lower))
    edits = known.table(words)
    terms = {word: INEXACT if edits[word] else 1.0 for word in words if edits[word] >= 0}
    if not terms:
        return 0.0, 0.0, 0
    places, weights, recent, quoted, at = [], [], [], 0, 0
    line_end = -1
    for number, match in enumerate(WORD.finditer(lower)):
        word, start = match[0], match.start()
        if start > line_end:
            line_start, line_end = lower.rfind("\n", 0, start) + 1, lower.find("\n", start)
            line_end = len(lower) if line_end < 0 else line_end
            quoted, at = 0, line_start
        if word in terms:
            quoted += len(QUOTE.findall(lower, at, start))
            at = start
            inside = quoted % 2 == 1 and QUOTE.search(lower, start, line_end) is not None
            cited = inside or any(w in REPORTING for w in recent[-REPORT_SPAN:])
            places.append(number)
            weights.append(terms[word] * (QUOTED if cited else 1.0))
        recent = [*recent[-REPORT_SPAN:], word]
    sums = np.concatenate([[0.0], np.cumsum(weights)])
    places = np.array(places)
    dense = max(sums[np.searchsorted(places, places + WINDOW, side="right")] - sums[: len(places)])
    return float(np.log1p(sums[-1])), float(np.log1p(dense)), len(places)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of the bounded training sample; held-out rows and null labels are never in it."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("label_id")
    toxic = known.filter("toxic = 1").orderBy(order, "label_id").limit(MOST_TOXIC)
    clean = known.filter("toxic = 0").orderBy(order, "label_id").limit(MOST_CLEAN)
    sample = F.broadcast(toxic.union(clean))  # at most MOST_TOXIC + MOST_CLEAN rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(sample, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")


def contexts(rows: DataFrame) -> DataFrame:
    """For every word its number of different contexts (word before, word after) in toxic and in clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part, seen = batch.slice(start, DOCS_AT_ONCE), set()
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = WORD.findall(text.lower())
                    seen.update(zip(words, ["", *words], [*words[1:], ""], [toxic] * len(words), strict=False))
                word, before, after, toxic = list(zip(*seen, strict=True)) if seen else ((), (), (), ())
                around = [f"{a} {b}" for a, b in zip(before, after, strict=True)]
                arrays = [pa.array(word, pa.string()), pa.array(around, pa.string()), pa.array(toxic, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "around", "toxic"])

    seen = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "word string, around string, toxic int")
    once = seen.select("word", "toxic", F.xxhash64("around").alias("around")).distinct()
    return once.groupBy("word").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_clean"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits lexicon and weights on the bounded sample; without labels of both kinds the lexicon is empty."""
    rows = stored(training_rows(docs, labels), "toxicity-sample")
    counts = stored(contexts(rows), "toxicity-words")
    pure = F.col("in_toxic") >= LEAST_SHARE * (F.col("in_toxic") + F.col("in_clean"))
    best = [F.col("in_toxic").desc()]
    stems = (
        counts.filter(F.length("word") > STEM_LENGTHS[0])
        .select("*", F.explode(F.array(*(F.lit(n) for n in STEM_LENGTHS))).alias("n"))
        .filter(F.length("word") > F.col("n"))
        .groupBy(F.substring("word", F.lit(1), F.col("n")).alias("stem"))
        .agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"), F.count_if(F.col("in_toxic") > 0).alias("forms"))
        .filter(pure & (F.col("in_toxic") >= LEAST_STEM_CONTEXTS) & (F.col("forms") >= LEAST_FORMS))
        .orderBy(*best, "stem")
        .limit(MOST_TERMS)
    )
    words = counts.filter(pure & (F.col("in_toxic") >= LEAST_CONTEXTS) & (F.length("word") >= 3)).orderBy(*best, "word").limit(MOST_TERMS)
    listed = sorted((r["stem"] for r in stems.collect()), key=len)
    kept: list[str] = []
    for stem in listed:
        if not any(stem.startswith(k) for k in kept):
            kept.append(stem)
    model = Model([r["word"] for r in words.collect() if not any(r["word"].startswith(k) for k in kept)], kept)
    return fitted(near_misses(model, counts), rows)


def near_misses(model: Model, counts: DataFrame) -> Model:
    """Adds the clean words of the sample that lie within an edit of a term; they must not count as misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            near = [w for w in batch.column(0).to_pylist() if lexicon.distance(w)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    clean = counts.filter("in_clean > 0").select("word").mapInArrow(run, "word string")
    return Model(model.words, model.stems, frozenset(r[0] for r in clean.collect()), model.weights)


def fitted(model: Model, rows: DataFrame) -> Model:
    """Logistic weights by Newton steps with a ridge, over two features of the bounded sample."""
    sample = with_features(rows, model, ["toxic"]).select("toxic", "total", "dense").toPandas()
    if sample["toxic"].nunique() < 2:
        return model
    x = np.column_stack([np.ones(len(sample)), sample["total"], sample["dense"]])
    y = sample["toxic"].to_numpy(float)
    prior = np.array(model.weights)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (y - p) - 0.1 * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), gradient)
        w = w + np.clip(step, -2, 2)
    return Model(model.words, model.stems, model.exempt, w.tolist())


def with_features(docs: DataFrame, model: Model, extra: list[str]) -> DataFrame:
    """Adds ``total``, ``dense``, ``n_hits`` and ``score`` to ``doc_id`` and the ``extra`` columns."""
    kept = ["doc_id", *extra]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "total double, dense double, n_hits long, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(model.lexicon())
        for batch in sliced(batches, DOCS_AT_ONCE):
            found = [features(t, known) for t in batch.column(len(kept)).to_pylist()]
            values = np.array(found, float).reshape(-1, 3)
            arrays = [*batch.columns[: len(kept)], *(pa.array(values[:, i]) for i in (0, 1)), pa.array(values[:, 2].astype(np.int64)), pa.array(model.score(values[:, :2]))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "total", "dense", "n_hits", "score"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_hits`` of every row.

    Null and empty texts have no hits and get the lowest score; a null id counts as held out; repeated rows give repeated
    rows, an empty table an empty result; other columns are ignored.
    """
    return with_features(docs, model, []).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits"
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with the columns they came with."""
    kinds = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(model.lexicon())
        for batch in sliced(batches, DOCS_AT_ONCE):
            found = [features(t, known)[:2] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.score(np.array(found, float).reshape(-1, 2)) < 0.5))

    return docs.mapInArrow(run, kinds)
