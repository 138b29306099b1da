"""Streaming forms of the keyed operators: bounded state, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key once while its state lives (``late`` after its time)."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def counts(stream: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows by window and key; a window is final when the watermark passes it."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), *by)
    return grouped.agg(F.count("*").alias("n"))


def latest_into(stream: DataFrame, key: str, time: str, path: str, checkpoint: str):
    """Keep the latest row of each key: each batch writes its own latest rows as
    a new version below ``path``; a reader takes the last by (time, batch)."""

    def write(batch: DataFrame, number: int) -> None:
        from skarn.operators.dedupe import keep_last

        rows = keep_last(batch, key, time)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
