"""Mapping, transforms and row rules on a stream.

These operators keep no state, so they run unchanged on a streaming DataFrame. Accepted and
rejected rows of each micro-batch go to their own folder; the batch number in the path makes a
repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablehaul.operators.project import MappingRow, apply_mapping, as_clean_text
from tablehaul.operators.validate import accepted, rejected, with_errors


def validated_stream(
    raw: DataFrame, targets: list[str], mapping: Iterable[MappingRow], checks: Iterable[tuple[str, Column]], row_no: str
) -> DataFrame:
    cleaned = as_clean_text(raw, [c for c in raw.columns if c != row_no])
    return with_errors(apply_mapping(cleaned, targets, mapping, keep=[row_no]), checks)


def start_routing(checked: DataFrame, row_no: str, accepted_path: str, rejected_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            accepted(batch).write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
            bad = rejected(batch, row_no).withColumnRenamed("__timestamp", "rejected_at")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        finally:
            batch.unpersist()

    writer = checked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
