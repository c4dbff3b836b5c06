import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablehaul.functions import similarity
from tablehaul.functions.thesaurus import thesaurus_rows
from tablehaul.operators import assign, simjoin, simkeys
from tests.test_functions import best_score, jaro_winkler, lev


def words(seed, count, alphabet, longest):
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(count)]

    def vary(word):
        chars = list(word)
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(chars) + 1), rng.randint(0, 2)
            if kind == 0:
                chars.insert(at, rng.choice(alphabet))
            elif kind == 1 and chars:
                chars.pop(min(at, len(chars) - 1))
            elif len(chars) > 1:
                at = min(at, len(chars) - 2)
                chars[at], chars[at + 1] = chars[at + 1], chars[at]
        return "".join(chars)

    return sorted({vary(w) for w in base} | {""}), sorted({vary(w) for w in base} | set(base))


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.85])
@pytest.mark.parametrize("alphabet,longest", [("abc", 8), ("aeinrstlodqz_ü", 20)])
def test_name_join_loses_no_pair(frame, threshold, alphabet, longest):
    left, right = words(3, 90, alphabet, longest)
    want = {(a, b) for a in left for b in right if best_score(a, b) >= threshold}
    rows = simjoin.similar_names(
        frame([(w,) for w in left], "l string"), frame([(w,) for w in right], "r string"), "l", "r", threshold
    ).collect()
    assert {(r.l, r.r) for r in rows} == want and len(rows) == len(want)
    assert all(abs(r.score - best_score(r.l, r.r)) < 1e-12 for r in rows)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_edit_join_loses_no_pair(frame, threshold):
    left, right = words(4, 120, "abcdef", 14)
    score = lambda a, b: 1 - lev(a, b) / max(len(a), len(b))
    want = {(a, b) for a in left for b in right if a and b and score(a, b) >= threshold}
    rows = simjoin.similar_by_edits(
        frame([(w,) for w in left], "l string"), frame([(w,) for w in right], "r string"), "l", "r", threshold
    ).collect()
    assert {(r.l, r.r) for r in rows} == want and len(rows) == len(want)


def test_mask_bound_holds_under_collisions():
    left, right = words(5, 150, "abcdefghijklmnopqrstuvwxyz0123456789éß", 40)
    for a in left[:80]:
        for b in right[:80]:
            (al, ah), (bl, bh) = simkeys.bag_bits(a), simkeys.bag_bits(b)
            ones = lambda *m: sum((v & (2**64 - 1)).bit_count() for v in m)
            bound = ones(al & bl, ah & bh) + min(len(a) - ones(al, ah), len(b) - ones(bl, bh))
            assert sum(min(a.count(c), b.count(c)) for c in set(a)) <= bound


def test_name_keys_prune_unlike_names():
    left, right = words(6, 200, "abcdefghijklmnopqrstuvwxyz", 14)
    a = [set(simkeys.name_keys(w, 0.85, True, {})) for w in left]
    b = [set(simkeys.name_keys(w, 0.85, False, {})) for w in right]
    met = sum(bool(x & y) for x in a for y in b)
    assert met < 0.1 * len(a) * len(b)


def test_share_of_pairs_that_meet_falls_with_the_vocabulary():
    """Keys combine more characters, the globally rarest first, when there are more strings."""
    rng = random.Random(8)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    word = lambda: "".join(rng.choices(letters, [1 / (i + 1) for i in range(26)], k=rng.randint(6, 12)))
    shares = []
    for n in (150, 1500, 15000):
        strings = [word() for _ in range(n)]
        counts = Counter(t for s in strings for t in simkeys.numbered(s))
        lists = [Counter(), Counter()]
        for side in (0, 1):
            for s in strings[side::2]:
                lists[side].update(simkeys.name_keys(s, 0.9, not side, counts, simkeys.characters_combined(n)))
        shares.append(sum(m * lists[1][k] for k, m in lists[0].items()) / (n / 2) ** 2)
    assert shares[0] > 1.5 * shares[1] > 2.25 * shares[2]


def test_jaro_of_many_pairs_equals_one_by_one():
    left, right = words(7, 150, "abcé", 12)
    pairs = [(a, b) for a in left for b in right] + [("", ""), ("", "a"), (None, "a"), ("a\0", "a"), ("x" * 300, "x" * 299 + "y"), ("ab" * 60, "ba" * 64)]
    got = similarity.jaro_of_pairs([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), score in zip(pairs, got.tolist(), strict=True):
        assert score != score if a is None else score == similarity._jaro(a, b), (a, b)


def test_groups_are_spread_by_their_number_of_pairs(frame, monkeypatch):
    monkeypatch.setattr(simjoin, "PAIRS_AT_ONCE", 500)
    left, right = words(10, 90, "abcde", 9)
    a, b = frame([("g", w) for w in left], "g string, l string"), frame([("g", w) for w in right], "g string, r string")
    rows = simjoin.similar_within(a, b, ["g"], "l", "r", 0.7).collect()
    assert {(r.l, r.r) for r in rows} == {(x, y) for x in left for y in right if best_score(x, y) >= 0.7} and len({(r.l, r.r) for r in rows}) == len(rows)


def test_one_to_one_equals_the_serial_loop(frame):
    rng = random.Random(9)
    rows, serial = [], {}
    for group in ("a", "b"):
        taken = set()
        for source in range(1, 41):
            likes = rng.sample(range(1, 31), rng.randint(1, 8))
            rows += [(group, "v", source, i + 1, t) for i, t in enumerate(likes)]
            pick = next((t for t in likes if t not in taken), None)
            if pick:
                taken.add(pick)
                serial[group, source] = pick
    choices = frame(rows, "object string, variant string, source_ordinal int, choice int, target_ordinal int")
    for most in (0, 160, 10**6):  # in rounds, mixed, in turn
        got = {(r.object, r.source_ordinal): r.target_ordinal for r in assign.assign_one_to_one(choices, most=most).collect()}
        assert got == serial


def test_preferences_order(frame):
    """Equal labels by priority first, then score; a thesaurus hit is worth 0.85."""
    sources = frame([("o", "v", 1, "Amount", None), ("o", "v", 2, "City Name", None)], "object string, variant string, ordinal int, field_name string, description string")
    targets = frame(
        [("o", "v", 1, "BETRAG", "Betrag", "x"), ("o", "v", 2, "AMNT", "amount", "x"), ("o", "v", 3, "CITYNAM", "Town", "city name")],
        "object string, variant string, ordinal int, field_name string, description string, field_group string",
    )
    rows = assign.preferences(sources, targets, ["description", "field_name", "field_group"]).orderBy("source_ordinal", "choice").collect()
    first = [(r.source_ordinal, r.target_ordinal, r.method, round(r.score, 3)) for r in rows]
    assert first[0] == (1, 2, "exact", 1.0)
    assert (1, 1, "synonym", 0.85) in first
    assert (2, 3, "exact", 1.0) == next(f for f in first if f[0] == 2)
    assert jaro_winkler("amount", "betrag") < 0.6


def test_one_to_one_over_catalogues_equals_a_plain_loop(spark):
    """The whole chain against a source-by-source loop over the smallest tables."""
    from collections import defaultdict

    from tablehaul.plans import catalogues, matching

    folder = "/root/testdata/sf0.001"
    concepts = defaultdict(set)
    for term, concept in thesaurus_rows():
        concepts[term].add(concept)
    norm = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    weighted = lambda a, b: 0.5 * (1 - lev(a, b) / max(len(a), len(b))) + 0.5 * jaro_winkler(a, b)
    sources, targets = defaultdict(list), defaultdict(list)
    for r in catalogues.sources(spark, folder).orderBy("ordinal").collect():
        sources[r.object, r.variant].append(r)
    for r in catalogues.targets(spark, folder).orderBy("ordinal").collect():
        targets[r.object, r.variant].append(r)
    want = {}
    for group, rows in sources.items():
        taken = set()
        for s in rows:
            pick = None
            for label in matching.LABELS:
                equal = [t for t in targets[group] if (t[label] or "").lower() == s.field_name.lower()]
                if equal and equal[-1].ordinal not in taken:
                    pick = equal[-1].ordinal
                    break
            best = 0.0
            for t in targets[group] if pick is None else []:
                if t.ordinal in taken:
                    continue
                a, b = norm(s.field_name), norm(t.field_name)
                scores = [weighted(a, norm(t[x])) for x in matching.LABELS if t[x]]
                score = max(x if x >= 0.6 else 0 for x in scores)
                if a == b or concepts[a] & concepts[b]:
                    score = max(score, 0.85)
                if score > best + 1e-12:
                    best, found = score, t.ordinal
            if pick is None and best > 0:
                pick = found
            if pick is not None:
                taken.add(pick)
                want[(*group, s.ordinal)] = pick
    got = {(r.object, r.variant, r.source_ordinal): r.target_ordinal for r in matching.match_one_to_one(spark, folder).collect()}
    assert got == want and len(want) > 20


def test_pairs_within_groups_match_a_loop(frame):
    rng = random.Random(8)
    names = lambda n: ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 7))) for _ in range(n)]
    groups = {g: (names(15), names(12)) for g in ("x", "y")}
    left = frame([(g, n) for g, (a, _) in groups.items() for n in a] + [("x", None)], "g string, n string")
    right = frame([(g, n) for g, (_, b) in groups.items() for n in b], "g string, n string")
    for threshold in (0.2, 0.6, 0.85):
        found = simjoin.similar_within(left, right, ["g"], "n", "n", threshold)
        rows = {(r.g, r.l, r.r): r.score for r in found.collect()}
        every = left.filter("n IS NOT NULL").distinct().withColumnRenamed("n", "l").join(right.distinct().withColumnRenamed("n", "r"), "g")
        scored = every.select("g", "l", "r", F.when(F.col("l") == F.col("r"), 1.0).otherwise(simjoin.name_score(F.col("l"), F.col("r"))).alias("s"))
        assert rows == {(r.g, r.l, r.r): pytest.approx(r.s) for r in scored.collect() if r.s >= threshold}


def test_twice_the_groups_meet_twice_as_often(frame):
    def met(n):
        rows = [(g, f"name{i}{j}") for g in range(n) for i in range(6) for j in range(3)]
        side = frame(rows, "g int, n string")
        return simjoin.similar_within(side, side, ["g"], "n", "n", 0.5).count()

    assert met(8) == 2 * met(4)
