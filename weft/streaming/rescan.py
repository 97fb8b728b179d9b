"""Incremental re-scan: a stream of file rows refreshes the repositories it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import refresh


def file_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files as they arrive, as Parquet, under path."""
    return spark.readStream.schema(schema).parquet(path)


def rescan(stream: DataFrame, current: Callable[[], DataFrame | None], publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each micro-batch, current() with the batch's repositories replaced goes to publish(table, batch id).

    publish must tell batches apart by id, so that a batch that is run again after a failure does no harm."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        before = current()
        publish(batch if before is None else refresh(before, batch), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type and window, late rows within the watermark counted; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
