"""The same operators over arriving files, and event-time windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def arriving_files(spark: SparkSession, path: str, glob: str = "*.[pP][dD][fF]") -> DataFrame:
    """(path, content) of files as they land in a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(path).select("path", "content")


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply work to each batch and write its rows under the batch's number: a batch that is run again replaces its own rows."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; works on streams (with late data) and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
