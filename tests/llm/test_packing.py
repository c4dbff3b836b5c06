"""Harmonic packing: plans against a plain count of every id, ids against the tokenizer itself, and edge cases."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablehaul.llm import packing, queries

DOCS = "doc_id long, text string, ids string, start long"
ODD = [
    None, "", " \n\t", "Hello, World! It's 12.5% of naïve CAFÉ… don't", "áb é, É", "x<|endoftext|>y <|startoftext|>", "….,", "ÀÉÎ! ß; ΣΑΣ, σας",
    "word " * 9000, "unbroken" * 3000, "tab\tnew\nline\x0bfeed\x0creturn\rno break  em", "!? .. ,. a., 'll 's", "日本語 テキスト。 emoji 🙂!",
]


@pytest.fixture(scope="module")
def tokenizer(spark):
    return queries.word_tokenizer(spark)


def plain_check(lengths, found, capacity):
    """Every id of every document lies in one piece; sequences have no gaps; none needs padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in zip(*(found[k].tolist() for k in ("doc", "start", "length", "sequence", "offset")), strict=True):
        assert length > 0
        pieces[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == n
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        short += at != capacity
    assert short <= capacity.bit_length()
    return pieces


@pytest.mark.parametrize("seed", range(30))
def test_plan_covers_every_id_without_padding(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100, 4096])
    shapes = [lambda: rng.randint(1, capacity * 3), lambda: rng.randint(1, max(1, capacity // 20)), lambda: capacity // 2 + 1, lambda: capacity, lambda: 1]
    lengths = [rng.choice(shapes[: rng.randint(1, 5)])() for _ in range(rng.choice([0, 1, 2, 30, 800]))]
    found = packing.plan(np.array(lengths, np.int64), capacity)
    assert len(found["doc"]) == 0 or lengths
    plain_check(lengths, found, capacity)


def test_classes_hold_a_fixed_count_and_few_documents_are_cut():
    rng = random.Random(1)
    lengths = [rng.randint(20, 4096) for _ in range(4000)]
    pieces = plain_check(lengths, packing.plan(np.array(lengths), 4096), 4096)
    assert sum(len(p) > 1 for p in pieces.values()) < 0.35 * len(lengths)
    equal = packing.plan(np.full(600, 1300), 4096)  # class 3, three to a sequence but for the rests that close the gaps
    counts = np.bincount(equal["sequence"][equal["length"] == 1300])
    assert counts.max() == 3 and (counts == 3).sum() > 150


def test_ids_are_those_of_the_tokenizer(tokenizer):
    own, whole = packing.WordIds(tokenizer), Tokenizer.from_str(tokenizer)
    texts = [t or "" for t in ODD] + ["A" * 10, "Mixed CASE, words. again mixed case words", "<|ENDOFTEXT|> İI\u0307 K"]
    for text, ids in zip(texts, own.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:40]


def test_long_texts_and_small_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 50)
    monkeypatch.setattr(packing, "MOST_KNOWN", 20)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcde,.é") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    want = Tokenizer.from_str(tokenizer).encode(text, add_special_tokens=False).ids
    for ids in packing.WordIds(tokenizer).ids([text.encode(), b"", text.encode()[:40], text.encode()][::3]):
        assert np.frombuffer(ids, "<u4").tolist() == want


def test_a_word_is_looked_up_once_however_often_it_stands_in_the_texts(tokenizer):
    own, asked = packing.WordIds(tokenizer), []
    table = own.words.table
    own.words.table = lambda keys: (asked.extend(keys), table(keys))[1]
    texts = ["of the river, of the sea", "", " \t", "\x0bThe sea\x0c of\r\n", "the " * 500, "of\x1cthe sea\x85\xa0"]
    found = list(own.ids([t.encode() for t in texts]))
    assert len(asked) == len(set(asked))
    whole = Tokenizer.from_str(tokenizer)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(own.ids([])) == []


def test_pack_on_odd_rows(spark, tokenizer):
    ids = [*range(len(ODD)), 3, None]
    texts = [*ODD, ODD[3], "null id"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)
    rows = packing.pack(docs, tokenizer).collect()
    whole = Tokenizer.from_str(tokenizer)
    want = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(r.length for r in rows) == sum(want)
    by_id = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_id[r.doc_id].append(r)
    for i, text in enumerate(texts[: len(ODD)]):
        if i != 3:
            got = b"".join(bytes(r.ids) for r in sorted(by_id[i], key=lambda r: r.start))
            assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def test_query_over_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op13_harmonic_packing"](spark, folder).collect()
    whole = Tokenizer.from_str(tokenizer)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    covered = defaultdict(int)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id] += r.length
    assert covered == {i: len(x) for i, x in ids.items()}
