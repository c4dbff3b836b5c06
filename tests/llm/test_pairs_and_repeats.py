"""SimHash groups, repeats and benchmark leaks against plain loops, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablehaul.llm import leaks, repeats, simhash
from tablehaul.llm.components import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def some_texts(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(n // 3)]
    passage = " ".join(f"p{i}" for i in range(26))
    while len(texts) < n:
        own = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", "\t "]).join(own) + (" " + passage if rng.random() < 0.3 else ""))
    return [*texts, None, "", " \n ", "a b c", "x " * 300]


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, ids):
    least = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for a, i in zip(fps, ids, strict=True):
            for b, j in zip(fps, ids, strict=True):
                if (a ^ b).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


@pytest.mark.parametrize("most_under_key", [8192, 3])
def test_groups_match_a_loop(spark, most_under_key):
    texts = some_texts(1)
    rows = simhash.groups(documents(spark, texts), most_under_key).collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(fps, list(range(len(texts))))


def test_crowded_keys_lose_no_link(spark):
    """Fingerprints around one centre: all keys are crowded, so the links come from keys that leave nine bits open."""
    rng = random.Random(5)
    fps = {0}
    while len(fps) < 60:
        value = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            value ^= 1 << rng.randrange(64)
        fps.add(value)
    signed = [(simhash.signed(f),) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 2).distinct().collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
    parent = {f: f for f, in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[root(r.a)] = root(r.b)
    for a, in signed:
        for b, in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                assert root(a) == root(b)


def test_groups_edge_cases(spark):
    assert simhash.groups(documents(spark, [])).count() == 0
    twice = documents(spark, ["a b c d", "a b c d", None, "x"], [7, 7, 3, None]).withColumnRenamed("source", "kept_id")
    rows = {(r.doc_id, r.component_id) for r in simhash.groups(twice).collect()}
    assert rows == {(7, 7), (3, 3), (None, None)}
    kept = simhash.keep_first(twice)
    assert kept.columns == twice.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 7, 7]


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    found = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def plain_repeats(rows, window=20):
    seen, out = {}, {}
    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), []).append((i, s))
    first = {k: min(v) for k, v in seen.items()}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("at_once", [600_000, 50])
def test_repeats_match_a_loop(spark, monkeypatch, at_once):
    monkeypatch.setattr(repeats, "WORDS_AT_ONCE", at_once)
    texts = some_texts(2) + some_texts(3)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.dedup(documents(spark, texts).repartition(5)).collect()}
    assert found == plain_repeats(list(enumerate(texts)))


def test_repeats_edge_cases(spark):
    assert repeats.dedup(documents(spark, [])).count() == 0
    text = " ".join(f"q{i}" for i in range(30))
    rows = documents(spark, [text, text, text, "q1 q2"], [4, 4, None, 4]).withColumnRenamed("lang", "text_key")
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in repeats.dedup(rows).collect())
    assert found == [(-1, 30, 30), (4, 2, 0), (4, 30, 0), (4, 30, 0)]


def test_copies_of_one_text_are_dealt_over_many_buckets(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = spark.createDataFrame([(i, 5, text) for i in range(40)], "rank long, text_key long, text string").repartition(3)
    told = repeats.anchors(rows, repeats.bucket_count(rows))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind in (repeats.FOUND, repeats.TOLD):
        assert told.filter(f"kind = {kind}").select("bucket").distinct().count() >= min(buckets, 40) // 2 > 1
    assert {r["rank"]: sorted(set(r["at"])) for r in repeats.gathered(told).collect()} == {i: list(range(21)) for i in range(40)}


def test_filter_keeps_all_keys(spark):
    rows = spark.range(2000).selectExpr("id AS rank", "id * 7 AS text_key")
    kept = repeats.in_filter(rows, rows.filter("rank % 10 = 0"), 1 << 16)
    assert rows.filter("rank % 10 = 0").exceptAll(kept).count() == 0 and kept.count() < 400


def test_planes_round_trip():
    values = np.array([0, 1, 255, 256, 2**40 - 1], np.uint64)
    assert repeats.from_planes(repeats.planes(values, 5), np.uint64, 5).tolist() == values.tolist()


ITEMS = [
    (1, "A farmer named Peter sells 12 apples for 30 cents each. How much money does Peter earn after he sells 5 kg of apples too?"),
    (2, "The quick brown fox jumps over the lazy dog while the sun shines on green meadows near the river."),
    (3, "too short"),
    (4, None),
    (5, "seven little words make one small item"),
]


def found_leaks(spark, texts, ids=None, **how):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks.leaks(documents(spark, texts, ids), items, **how).collect()}


def test_leaks_by_template(spark):
    same = f"Some words before. {ITEMS[0][1]} And after."
    other = "Exercise. A farmer named Maria Stone sells 48 apples for 75 cents each. How much money does Maria Stone earn after he sells 9 kg of apples too?"
    mixed = "Exercise. A farmer named Maria sells 48 apples for 75 cents each. How much money does Paula earn after he sells 9 kg of apples too?"
    clean = "A farmer named Peter sleeps. The brown dog jumps over the river and the sun shines."
    found = found_leaks(spark, [same, other, mixed, clean, "Seven little words make one small item", ITEMS[1][1].upper(), None, ""], least_share=0.9, enough=99)
    assert set(found) == {(0, 1), (1, 1), (4, 5), (5, 2)}
    assert found[0, 1].n_changed == 0 and found[1, 1].n_changed == 4 and found[0, 1].share == 1.0


def plain_leaks(texts, items, least_share=leaks.LEAST_SHARE, enough=leaks.ENOUGH):
    """Every text against every item by tuples of tokens: no hashes, bits, arrays or joins."""
    found = {}

    def read(text):
        for reading, (tokens, slots) in enumerate(leaks.templates(text)):
            at = {p: (kind, value) for p, kind, value in slots}
            yield reading, tokens, at

    def windows(tokens, at, width):
        if len(tokens) < leaks.LEAST_TOKENS:
            return []
        starts = range(len(tokens) - width + 1)
        return [(i, tuple(tokens[i : i + width])) for i in starts if sum(j not in at for j in range(i, i + width)) >= leaks.LEAST_PLAIN]

    exact = lambda tokens, at: [at[i][1] if i in at else t for i, t in enumerate(tokens)]
    for item, item_text in items:
        own = [(tokens, at, windows(tokens, at, min(leaks.WINDOW, len(tokens)))) for _, tokens, at in read(item_text)]
        for doc, text in texts:
            best = []
            for reading, tokens, at in read(text):
                item_tokens, item_at, wanted = own[reading]
                there = windows(tokens, at, min(leaks.WINDOW, len(item_tokens)))
                most = min(enough, -(-len(wanted) * least_share // 1))
                pairs = lambda i, d: [(item_at[i + k][0], item_at[i + k][1], at[d + k][1]) for k in range(leaks.WINDOW) if i + k in item_at and k < min(leaks.WINDOW, len(item_tokens))]  # noqa: E731, B023
                met = [(i, d, pairs(i, d)) for i, w in wanted for d, v in there if w == v]
                for shift in (0, leaks.BAND // 2):
                    for band in {(d - i + shift) // leaks.BAND for i, d, _ in met}:
                        n, changed = leaks.aligned([m for m in met if (m[1] - m[0] + shift) // leaks.BAND == band])
                        if n and n >= most:
                            best.append((n, -changed, -len(wanted)))
            if not any(w for _, _, w in own):
                (tokens, at, _), (_, mine, my_at) = own[-1], list(read(text))[-1]
                if tokens and exact(tokens, at) == exact(mine, my_at):
                    best.append((1, 0, -1))
            if best:
                n, changed, size = max(best)
                found[doc, item] = (n, -changed, n / -size)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_leaks_equal_plain_comparison(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(leaks, "MOST_BITS", 1 << 15)
        monkeypatch.setattr(leaks, "TEXTS_AT_ONCE", 3)
    rng = random.Random(seed)
    words = ["sun", "Tom", "Ann", "river", "7", "12.5", "kg", "three", "m", "%", "€", "gives", "Old", "bread", "to", "a", "is", "l'été", "Ⅷ", "²", "x\x00y", "\x00", "M", "Days"]
    marks = [" ", " ", " ", " ", ", ", ". ", "\n", "! ", " - ", "  "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 6, 9, 14, 25]))) for i in range(14)] + [(20, "1 2 3"), (21, "Yes."), (22, None), (23, " 5 kg, 7 kg 9 kg 8 m 3 % 1 2 3 4")]
    docs = [text(rng.randint(0, 60)) for _ in range(25)]
    for _ in range(40):
        own = rng.choice(items)[1] or ""
        changed = " ".join(rng.choice(words) if rng.random() < 0.08 else w for w in own.split(" "))
        docs.append(rng.choice(["", text(5)]) + rng.choice([own, changed, changed.lower(), own.upper()]) + rng.choice(["", " " + text(4)]))
    docs += ["1, 2 3", "yes", "YES", "Yes or no", "5 kg 7 kg 9 kg 8 m 3 % 1 2 3 4", "5 kg 7 kg 9 kg 8 m 3 % 1 2 3 5", None, "long " * 3000 + (items[3][1] or "")]
    rows = leaks.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_changed, r.share) for r in rows}
    assert got == plain_leaks(list(enumerate(docs)), items)


def test_number_tables_hold_no_item(spark):
    items = spark.createDataFrame([(1, "Row " + " ".join(map(str, range(1, 19))))], "item_id long, text string")
    prices = "Row " + " ".join(str(p) for p in (19, 5, 7, 88, 4, 12, 9, 31, 2, 6, 45, 3, 8, 71, 10, 13, 27, 64, 1, 99))
    texts = [prices, "Row " + ", ".join(map(str, range(1, 19)))]
    assert {r.doc_id for r in leaks.leaks(documents(spark, texts), items).collect()} == {1}


def test_leaks_edge_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [ITEMS[1][1], ITEMS[1][1], "clean words only, and many of them"], [None, 8, 9]).withColumnRenamed("lang", "leak_id")
    assert leaks.leaks(docs, none).count() == 0
    kept = leaks.without_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [9]
    assert leaks.without_leaks(docs.limit(0), none).count() == 0


def test_leaks_with_names_at_sentence_starts_and_in_other_case(spark):
    items = spark.createDataFrame([(1, "Tom has 3 pens. Tom gives 2 to Ann. How many pens are left?"), ITEMS[0]], "item_id long, text string").withColumn("item_id", F.xxhash64("text"))
    first, second = (items.filter(f"text LIKE '{start}%'").first().item_id for start in ("Tom", "A farmer"))
    texts = [
        "Eva has 3 pens. Eva gives 2 to Ann. How many pens are left?",
        f"some words before {ITEMS[0][1].lower()}",
        f"Mixed text here, then {ITEMS[0][1].upper()}",
        "Eva sleeps. How many pens are there?",
    ]
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(documents(spark, texts), items).collect()} == {(0, first), (1, second), (2, second)}


def test_leaks_with_slots_that_do_not_go_one_to_one(spark):
    item = "In 1990 the old mill by the river sold 3 loaves and 5 rolls to every guest, and since 1990 the owner kept a book of all sales."
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("since 1990", "since 1991"), item.replace("3 loaves and 5", "4 loaves and 4")]
    assert {(r.doc_id, r.n_changed) for r in leaks.leaks(documents(spark, texts), items).collect()} == {(0, 1), (1, 2)}


def test_leaks_with_words_put_in_or_left_out(spark):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(words[:10] + ["really"] + words[10:]), " ".join(words[:10] + words[11:]), " ".join(words[10:] + words[:10])]
    found = {r.doc_id: r.n_windows for r in leaks.leaks(documents(spark, texts), items).collect()}
    assert found == {0: 6} and leaks.aligned([(0, 5, []), (1, 4, []), (2, 7, [])]) == (2, 0)
    assert {r.doc_id for r in leaks.leaks(documents(spark, texts), items, enough=5).collect()} == {0, 1}
