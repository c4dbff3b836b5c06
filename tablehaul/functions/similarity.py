"""String similarity as column expressions.

Levenshtein is a Spark builtin. Jaro is not: it runs in Arrow batches on candidate pairs, since a
fold over characters with ``aggregate`` cost about seven times as much per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal, one empty scores 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(longest == 0, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(1.0 - F.levenshtein(a, b) / longest)
    )


def _jaro(a: str, b: str) -> float:
    la, lb = len(a), len(b)
    if not la or not lb:
        return float(la == lb)
    reach = max(max(la, lb) // 2 - 1, 0)
    rest, hits = list(b), []
    for i, char in enumerate(a):
        low, high = max(i - reach, 0), min(i + reach + 1, lb)
        if char in rest[low:high]:
            rest[rest.index(char, low, high)] = None
            hits.append(char)
    if not hits:
        return 0.0
    matched = (c for c, left in zip(b, rest) if left is None)
    moved = sum(x != y for x, y in zip(hits, matched))
    n = len(hits)
    return (n / la + n / lb + (n - moved / 2) / n) / 3


#: Strings up to this length are compared as arrays, so many pairs at a time that a table of characters stays small.
LONGEST_ARRAY, CHARACTERS_AT_ONCE = 256, 1 << 20


def _characters(texts: list[str], width: int) -> np.ndarray:
    """Code points by string and place; zero behind the end of a string."""
    return np.array(texts, f"<U{max(width, 1)}").view("<u4").reshape(len(texts), -1)


def _jaro_arrays(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of non-empty strings, pair by pair: all first characters look for a partner at once, then all second ones."""
    la, lb = np.array(list(map(len, left))), np.array(list(map(len, right)))
    a, b = _characters(left, la.max()), _characters(right, lb.max())
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    places, pairs = np.arange(b.shape[1]), np.arange(len(left))
    free, hits = places < lb[:, None], np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        near = (b == a[:, i : i + 1]) & free & (abs(places - i) <= reach[:, None])
        first = near.argmax(axis=1)
        found = near[pairs, first] & (i < la)
        hits[found, i] = True
        free[pairs[found], first[found]] = False
    n = hits.sum(axis=1)
    taken = (places < lb[:, None]) & ~free
    most = n.max()
    in_order = lambda table, mask: np.take_along_axis(table, np.argsort(~mask, axis=1, kind="stable"), axis=1)[:, :most]
    moved = ((in_order(a, hits) != in_order(b, taken)) & (np.arange(most) < n[:, None])).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (n / la + n / lb + (n - moved / 2) / n) / 3, 0.0)


def jaro_of_pairs(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Jaro similarity of pairs; missing strings give NaN. Pairs of like length are compared together."""
    out = np.full(len(left), np.nan)
    short: list[int] = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is None or y is None:
            continue
        if x and y and max(len(x), len(y)) <= LONGEST_ARRAY and "\0" not in x and "\0" not in y:
            short.append(i)
        else:
            out[i] = _jaro(x, y)
    short.sort(key=lambda i: max(len(left[i]), len(right[i])))
    while short:
        n = max(1, CHARACTERS_AT_ONCE // (LONGEST_ARRAY if len(left[short[-1]]) > 64 else 64))
        part, short = short[:n], short[n:]
        out[part] = _jaro_arrays([left[i] for i in part], [right[i] for i in part])
    return out


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity with half transpositions (an odd count is not rounded down)."""
    found = jaro_of_pairs(a.tolist(), b.tolist())
    return pd.Series(found, dtype="Float64").mask(np.isnan(found), pd.NA)


def common_prefix(a: Column, b: Column, limit: int = 4) -> Column:
    """Length of the common prefix, at most ``limit``."""
    length = F.lit(0)
    for n in range(1, limit + 1):
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
        length = F.when(same, F.lit(n)).otherwise(length)
    return length


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """Jaro plus 0.1 per common prefix character, without a lower gate on Jaro."""
    jaro = jaro_similarity(a, b)
    return jaro + 0.1 * common_prefix(a, b) * (1 - jaro)


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring.

    The best length can grow by at most one per end position, so one pass is enough.
    """
    grown = F.aggregate(
        F.sequence(F.lit(1), F.length(a)),
        F.lit(0),
        lambda best, end: best
        + F.when(
            (end > best) & F.contains(b, F.substring(a, end - best, best + 1)), F.lit(1)
        ).otherwise(F.lit(0)),
    )
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(grown)


def weighted_similarity(
    a: Column, b: Column, levenshtein_weight: float = 0.5, jaro_winkler_weight: float = 0.5
) -> Column:
    """Weighted sum of both measures; a weight of zero switches a measure off."""
    score = F.lit(0.0)
    if levenshtein_weight:
        score = score + levenshtein_similarity(a, b) * levenshtein_weight
    if jaro_winkler_weight:
        score = score + jaro_winkler_similarity(a, b) * jaro_winkler_weight
    return score
