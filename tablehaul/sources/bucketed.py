"""Tables stored in buckets, so that joins and aggregations on their key need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tablehaul.session import new_output


def store_bucketed(df: DataFrame, keys: list[str], buckets: int, name: str = "bucketed") -> DataFrame:
    """Writes ``df`` as a table bucketed and sorted by ``keys`` and reads it back.

    Two tables with equal buckets meet bucket by bucket: ``validate.orphans`` over them shuffles neither. The rows are shuffled
    once, when they are stored; that pays when a table is checked against several others or again and again. Choose the number of buckets
    by size (some hundred MB each), the same for all tables of a key.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys)  # one file for each bucket
    placed.write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).option("path", new_output(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)
