"""URL filters by a sort-merge range join of reversed hosts.

A host turns into its labels from right to left, each followed by a dot (``net.example.blog.``). All hosts that a rule
fits then lie in one interval, from the rule's key up to the same key with its last dot raised by one character. Urls and
rules are sorted together into ranges; a rule is copied to each range that its interval meets. One sweep over a range
keeps the rules whose interval is open on a stack, nested as the intervals are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm.ranges import limits
from tablehaul.llm.text import dealt_by, width

#: The production rules: host, start of the path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    rows = list(rules)
    if any(not host for host, _, _ in rows):
        raise ValueError("a rule needs a host")
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host`` and ``path``; both empty if the url is null or has no ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest")), "^[^?#]*", 0)
    return (
        pages.select("page_id", rest.alias("_rest"))
        .withColumn("_host", host)
        .select("page_id", F.translate("_host", UPPER, LOWER).alias("host"), path.alias("path"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict on every page: that of the longest rule that fits, else ``default``.

    The length of a rule is that of its host and path together; of equally long rules the one with the longer host wins,
    of rules with the same host and path the larger verdict (``block``). Null ids and repeated rows stay as they are, an
    empty table gives an empty result, other columns are ignored.
    """
    spark = pages.sparkSession
    n = width(spark)
    salt = F.xxhash64("page_id")
    urls = with_parts(pages).withColumn("key", host_key(F.col("host"))).withColumn("salt", salt)
    cuts = limits(urls, ["key", "path", "salt"], F.xxhash64("salt", "key", "path"), n)
    cuts = [(k.encode(), p.encode(), s) for k, p, s in cuts]

    @F.pandas_udf("int")
    def place(key: pd.Series, path: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, (k.encode(), p.encode(), s)) for k, p, s in zip(key, path, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        first = [bisect_right(cuts, (k.encode(), b"", -(2**63))) for k in key]
        last = [bisect_right(cuts, (k[:-1].encode() + b"/", b"", -(2**63))) for k in key]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last, strict=True)])

    keyed = rules.withColumn("key", host_key(F.translate("host", UPPER, LOWER)))
    rule_rows = keyed.select(
        F.explode(places("key")).alias("part"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast("long").alias("page_id"), "host", "verdict"
    )
    url_rows = urls.select(
        place("key", "path", "salt").alias("part"), "key", F.lit(1).alias("kind"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict")
    )
    dealt = dealt_by(url_rows.unionByName(rule_rows), "part", "key", "kind", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(default)
        for batch in batches:
            out = {"page_id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for part, key, kind, path, page_id, host, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.move(part, key)
                if kind == 0:
                    sweep.open(key, host, path, verdict)
                    continue
                rule, found = sweep.longest(path)
                for name, value in zip(out, (page_id, host, path, rule, found), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=RESULT)

    return dealt.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


RESULT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


class Sweep:
    """The stack of open intervals: for each host key, its rules by path."""

    def __init__(self, default: str) -> None:
        self.default, self.part, self.stack = default, None, []

    def move(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, set()))
        _, _, by_path, lengths = self.stack[-1]
        by_path[path] = max(verdict, by_path.get(path, verdict))
        lengths.add(len(path))

    def longest(self, path: str) -> tuple[str | None, str]:
        best, found = -1, (None, self.default)
        for key, host, by_path, lengths in reversed(self.stack):
            for n in sorted(lengths, reverse=True):
                if n <= len(path) and path[:n] in by_path:
                    if len(key) + n > best:
                        best, found = len(key) + n, (host + path[:n], by_path[path[:n]])
                    break
        return found
