"""Range partitions whose limits depend on the rows alone, not on how they were dealt out."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled rows for each range, and in all. The sample only balances the ranges; every row is placed.
SAMPLE, MOST_SAMPLED = 60, 1_000_000


def limits(df: DataFrame, key: list[str], salt: Column, n: int) -> list[tuple]:
    """Up to ``n - 1`` upper limits that cut the sorted rows into ranges of about equal size.

    The sample holds the rows whose hash ``salt`` is below a share of all hashes, about ``SAMPLE * n`` or ``MOST_SAMPLED`` of them; equal
    keys come as one row with their number. So a key that holds a third of all rows gets a third of the ranges if ``key``
    ends in a value that tells its rows apart.
    """
    total = df.count() if n > 1 else 0
    if not total:
        return []
    share = min(1.0, min(SAMPLE * n, MOST_SAMPLED) / total)
    below = F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))
    taken = df.select(*key, salt.alias("_salt")).filter(F.col("_salt") <= below).groupBy(*key).agg(F.count("*").alias("_rows"))
    rows = sorted(tuple(r) for r in taken.dropna().collect())
    if not rows:
        return []
    ends = list(accumulate(r[-1] for r in rows))
    return sorted({rows[bisect_right(ends, ends[-1] * i // n)][:-1] for i in range(1, n)})
