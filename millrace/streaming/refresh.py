"""Refreshing by Structured Streaming: an addition, for sources that only grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def landing(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """New Parquet files of a landing directory as a stream."""
    return spark.readStream.schema(schema).parquet(directory)


def refresh(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream to a table, each row once; with every (an interval) on and on, else until all is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a refresh for every batch of new rows."""
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window and group; what is later than late is left out. Works on streams and tables alike."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
