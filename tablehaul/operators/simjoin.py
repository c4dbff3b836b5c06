"""Similarity joins over distinct strings without comparing all pairs.

Both joins are exact: a pair at or above the threshold always shares at least one key, keys are
joined with an ordinary equi-join, and the pairs that meet are filtered by a bound or by their
score. Only pairs that pass are shuffled again, to drop duplicates. A key that many strings share
makes a large join partition, which adaptive execution splits.

*Edits* (``similar_by_edits``): if a string of length n is cut into k + 1 segments, a partner
within k edits contains one segment unchanged, at a place the edit budget bounds.

*Names* (``similar_names``; the larger of Levenshtein similarity and Jaro-Winkler): Jaro at or
above j needs at least (3j - 1) * la * lb / (la + lb) characters in common, counted with
multiplicity, and Levenshtein similarity at the same level needs no fewer. Winkler's prefix bonus
only helps pairs that share their first characters, so three classes cover all pairs: any prefix
(no bonus), first character shared (bonus of at most two characters), first three shared (bonus
of at most four). In each class characters are ordered from rare to frequent, and strings that
share q characters must agree on some combination of their rarest ones. What is rare is counted over all
strings, and the more strings there are, the more characters are combined, so that lists stay short. Before a
pair is scored, bit masks of its characters bound both measures from above.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.functions.similarity import common_prefix, jaro_winkler_similarity, levenshtein_similarity
from tablehaul.operators import simkeys


def _keyed(strings: DataFrame, name: str, make: Callable[[str], list[str]]) -> DataFrame:
    """(string, key) rows; the text key is hashed, and a collision only adds a pair to score."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(make)

    # Outer, or the planner adds a filter that runs the function a second time.
    spread = strings.select(name, F.explode_outer(keys(F.col(name))).alias("__key"))
    return spread.filter(F.col("__key").isNotNull()).select(name, F.xxhash64("__key").alias("key"))


def similar_by_edits(left: DataFrame, right: DataFrame, l: str, r: str, threshold: float = 0.8) -> DataFrame:
    """Pairs (l, r, score) of distinct non-empty strings with Levenshtein similarity >= threshold."""
    a = left.select(F.col(l).alias("l")).filter(F.col("l") != "").distinct()
    b = right.select(F.col(r).alias("r")).filter(F.col("r") != "").distinct()
    probe = _keyed(a, "l", lambda s: simkeys.probe_keys(s, threshold))
    index = _keyed(b, "r", lambda s: simkeys.index_keys(s, threshold))
    longer = F.greatest(F.length("l"), F.length("r"))
    distance = F.levenshtein(F.col("l"), F.col("r"))
    met = probe.join(index, "key").select("l", "r", (1.0 - distance / longer).alias("score"))
    return met.filter(F.col("score") >= threshold).dropDuplicates(["l", "r"])


def name_score(l: Column, r: Column) -> Column:
    """The larger of Levenshtein similarity and Jaro-Winkler."""
    return F.greatest(levenshtein_similarity(l, r), jaro_winkler_similarity(l, r))


def similar_names(left: DataFrame, right: DataFrame, l: str, r: str, threshold: float = 0.8, score=name_score) -> DataFrame:
    """Pairs (l, r, score) of distinct strings with score >= threshold; equal strings score 1.

    ``score`` may be any function that never exceeds the larger of the two measures.
    """
    if threshold <= 1 / 3:
        raise ValueError("below one third nothing bounds the common characters")
    a = left.select(F.col(l).alias("l")).filter(F.col("l").isNotNull()).distinct()
    b = right.select(F.col(r).alias("r")).filter(F.col("r").isNotNull()).distinct()
    equal = a.join(b, F.col("l") == F.col("r")).select("l", "r", F.lit(1.0).alias("score"))
    counts, strings = character_counts(a.select(F.col("l").alias("s")).unionByName(b.select(F.col("r").alias("s"))))
    characters = simkeys.characters_combined(strings)
    lk = _name_keyed(a, "l", threshold, True, counts, characters)
    rk = _name_keyed(b, "r", threshold, False, counts, characters)
    met = lk.join(rk, "key").filter((F.col("l") != F.col("r")) & (_score_bound() >= threshold - simkeys.EPS))
    pairs = met.select("l", "r").distinct()
    scored = pairs.select("l", "r", score(F.col("l"), F.col("r")).alias("score"))
    return equal.unionByName(scored.filter(F.col("score") >= threshold))


def character_counts(strings: DataFrame) -> tuple[dict[tuple[str, int], int], int]:
    """How many strings hold a character, a second one of it, and so on up to ``simkeys.COUNTED``; and the number of strings.

    The table has an entry for each distinct character at most ``COUNTED`` times, whatever the number of strings.
    """

    @F.pandas_udf("array<struct<c:string,k:int,n:long>>")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            seen = Counter(t for s in part for t in simkeys.numbered(s) if t[1] <= simkeys.COUNTED)
            rows = [{"c": c, "k": k, "n": n} for (c, k), n in seen.items()]
            yield pd.Series([rows, *([] for _ in range(len(part) - 1))])

    found = strings.select(F.explode_outer(counted("s")).alias("t")).groupBy("t.c", "t.k").agg(F.sum("t.n").alias("n"))
    return {(r.c, r.k): r.n for r in found.collect() if r.c is not None}, strings.count()


#: Pairs of a group that one join key holds.
PAIRS_AT_ONCE = 2_000_000


def similar_within(left: DataFrame, right: DataFrame, by: list[str], l: str, r: str, threshold: float = 0.8, score=name_score) -> DataFrame:
    """Rows (by, l, r, score) of strings of one group with score >= threshold; any threshold will do.

    The strings of a group meet each other and no others, so the work follows the number of groups. A group is spread over
    as many join keys as its counted number of pairs needs. Length and character masks cut the pairs before they are
    scored, and each distinct pair is scored once, however many groups hold it.
    """
    a = _masked(left.filter(F.col(l).isNotNull()).select(*by, F.col(l).alias("l")).distinct(), "l")
    b = _masked(right.filter(F.col(r).isNotNull()).select(*by, F.col(r).alias("r")).distinct(), "r")
    sizes = a.groupBy(*by).agg(F.count("*").alias("__a")).join(b.groupBy(*by).agg(F.count("*").alias("__b")), by)
    sizes = sizes.select(*by, F.least(F.ceil(F.col("__a") * F.col("__b") / PAIRS_AT_ONCE), F.col("__b")).cast("int").alias("__salts"))
    spread = a.join(sizes, by).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    salted = b.join(sizes, by).withColumn("__salt", F.pmod(F.xxhash64("r"), F.col("__salts")).cast("int")).drop("__salts")
    close = (F.col("l") == F.col("r")) | (_score_bound() >= threshold - simkeys.EPS)
    met = spread.join(salted, [*by, "__salt"]).filter(close).select(*by, "l", "r")
    pairs = met.filter(F.col("l") != F.col("r")).select("l", "r").distinct()
    scored = pairs.select("l", "r", score(F.col("l"), F.col("r")).alias("score")).filter(F.col("score") >= threshold)
    equal = met.filter(F.col("l") == F.col("r")).select(*by, "l", "r", F.lit(1.0).alias("score"))
    return equal.unionByName(met.join(scored, ["l", "r"]).select(*by, "l", "r", "score"))


def _masked(strings: DataFrame, name: str) -> DataFrame:
    @F.pandas_udf("low long, high long")
    def masks(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([simkeys.bag_bits(s) for s in texts], columns=["low", "high"])

    made = strings.withColumn("__m", masks(F.col(name)))
    return made.withColumns({f"{name}_low": F.col("__m.low"), f"{name}_high": F.col("__m.high")}).drop("__m")


_NAME_KEYS = T.StructType(
    [T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
)


def _name_keyed(
    strings: DataFrame, name: str, threshold: float, is_left: bool, counts: dict[tuple[str, int], int], characters: int
) -> DataFrame:
    """(string, its character masks, key) rows."""

    @F.pandas_udf(_NAME_KEYS)
    def keys(texts: pd.Series) -> pd.DataFrame:
        bits = [simkeys.bag_bits(s) for s in texts]
        found = [simkeys.name_keys(s, threshold, is_left, counts, characters) for s in texts]
        return pd.DataFrame({"keys": found, "low": [b[0] for b in bits], "high": [b[1] for b in bits]})

    made = strings.select(name, keys(F.col(name)).alias("k"))
    masks = [F.col("k.low").alias(f"{name}_low"), F.col("k.high").alias(f"{name}_high")]
    spread = made.select(name, *masks, F.explode_outer("k.keys").alias("__key")).filter(F.col("__key").isNotNull())
    return spread.select(name, f"{name}_low", f"{name}_high", F.xxhash64("__key").alias("key"))


def _score_bound() -> Column:
    """No less than either measure of (l, r), from masks, lengths and common prefix."""
    la, lb = F.length("l"), F.length("r")
    own = lambda s: F.bit_count(f"{s}_low") + F.bit_count(f"{s}_high")
    both = F.bit_count(F.col("l_low").bitwiseAND(F.col("r_low"))) + F.bit_count(F.col("l_high").bitwiseAND(F.col("r_high")))
    common = F.least(both + F.least(la - own("l"), lb - own("r")), la, lb)
    jaro = F.coalesce((F.try_divide(common, la) + F.try_divide(common, lb) + 1) / 3, F.lit(0.0))
    return F.greatest(jaro + 0.1 * common_prefix(F.col("l"), F.col("r")) * (1 - jaro), F.coalesce(F.try_divide(common, F.greatest(la, lb)), F.lit(0.0)))
