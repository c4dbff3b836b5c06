"""1-based row numbers, over a table or within groups of any size, without a task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.session import cut_lineage


def number_rows(df: DataFrame, order_by: list[str], name: str = "row_no") -> DataFrame:
    """Number rows in the order of ``order_by`` (give a unique key for a stable result).

    Rows are range-partitioned and sorted; ``monotonically_increasing_id`` then carries the
    partition and the position in it. The numbered rows are checkpointed, because range bounds
    are sampled and must not change between counting and numbering. Only one count per
    partition reaches the driver.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    placed = cut_lineage(ordered.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offset, running = {}, 0
    for row in sorted(counts, key=lambda r: r["part"]):
        offset[row["part"]] = running
        running += row["n"]
    return placed.select(
        (_lookup(offset, part) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name),
        *df.columns,
    )


def number_within(df: DataFrame, by: list[str], order_by: list[str], name: str = "row_no") -> DataFrame:
    """Number the rows of each group in order, whatever share of the rows one group has.

    Rows are range-partitioned by group and order, so a large group spans many partitions and a
    partition holds each of its groups in one run. The run's start and its rows in earlier
    partitions (one row per group and partition) give the number.
    """
    keys = [*by, *order_by]
    ordered = df.repartitionByRange(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    placed = cut_lineage(ordered.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy(*by, "__part").agg(F.min("__at").alias("__start"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    left, right = placed.alias("l"), runs.alias("r")
    same = F.col("l.__part") == F.col("r.__part")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    number = F.col("r.__before") + F.col("l.__at") - F.col("r.__start") + 1
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in df.columns], number.alias(name))


def _lookup(values: dict[int, int], key: Column) -> Column:
    if not values:
        return F.lit(0).cast("long")
    size = max(values) + 1
    table = F.array(*[F.lit(values.get(i, 0)).cast("long") for i in range(size)])
    return F.get(table, key.cast("int"))
