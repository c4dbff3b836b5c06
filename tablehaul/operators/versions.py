"""The change log between two versions of a table: inserted, deleted and updated keys, and which fields changed.

Keys travel with two 64-bit hashes of their row only; whole rows are fetched for the keys that differ, and only those rows
are taken apart into fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.operators.project import quoted
from tablehaul.session import cut_lineage


def signed(df: DataFrame, keys: list[str], columns: list[str], side: str) -> DataFrame:
    """Keys (as ``__key0`` and on) and the row's hashes; null and the text of a null hash differently."""
    values = [F.struct(quoted(c).isNull(), quoted(c)) for c in columns]
    hashes = F.struct(F.xxhash64(*values), F.xxhash64(F.lit("second"), *values))
    return df.select(*[quoted(k).alias(f"__key{i}") for i, k in enumerate(keys)], hashes.alias(side))


def same_key(n: int, left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.__key{i}").eqNullSafe(F.col(f"{right}.__key{i}")) for i in range(n)])


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``__key0`` and on, ``change`` (insert, delete or update) of every key whose rows differ; only keys and hashes are shuffled."""
    left, right = signed(old, keys, columns, "before").alias("l"), signed(new, keys, columns, "after").alias("r")
    both = left.join(right, same_key(len(keys), "l", "r"), "full_outer")
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    names = [F.coalesce(f"l.__key{i}", f"r.__key{i}").alias(f"__key{i}") for i in range(len(keys))]
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*names, change.alias("change"))


def change_log(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``keys``, ``change``, ``field``, ``original``, ``transformed`` (as text): a row for each field that changed.

    An inserted or deleted row has an entry for each field that is not null on its only side; if all are null, one entry
    with a null ``field``. Keys are expected to be unique in each version (``validate.duplicate_keys`` finds the others); null
    keys are keys like others. Columns of ``columns`` that a version lacks count as null there.
    """
    columns = columns or [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    text = lambda df: df.select(
        *[quoted(k) for k in keys], *[(quoted(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    )
    old, new = text(old), text(new)
    changed = cut_lineage(changed_keys(old, new, keys, columns))  # used for both versions

    def rows(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*[quoted(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.struct(*[quoted(c) for c in columns]).alias(side))
        joined = changed.alias("c").join(named.alias("r"), same_key(len(keys), "c", "r"))
        return joined.select(*[F.col(f"c.__key{i}") for i in range(len(keys))], "change", side)

    left, right = rows(old, "before").alias("l"), rows(new, "after").alias("r")
    both = left.join(right, same_key(len(keys), "l", "r"), "full_outer")
    value = lambda side, c: F.col(side).getField(c)
    entries = F.array(*[F.struct(F.lit(c).alias("field"), value("before", c).alias("original"), value("after", c).alias("transformed")) for c in columns])
    differing = F.filter(entries, lambda e: ~e["original"].eqNullSafe(e["transformed"]))
    names = [F.coalesce(f"l.__key{i}", f"r.__key{i}").alias(k) for i, k in enumerate(keys)]
    return both.select(*names, F.coalesce("l.change", "r.change").alias("change"), F.inline_outer(differing))
