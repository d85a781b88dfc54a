"""Sessions of events, on a table or a stream, by one definition; late rows of a stream are counted and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampType

GAP = "30 minutes"


def sessions(events: DataFrame, time: str, key: str, gap: str = GAP, value: str | None = None) -> DataFrame:
    """key, session_start, session_end (gap after the last event), events and, of a value, its total: one row a session.

    Events of a key that lie at most gap apart are of one session. An event without a time or key is of none. On a stream with a watermark a session comes out once no event within the watermark can join it.
    """
    known = events.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    more = [] if value is None else [F.sum(value).alias("total")]
    # A cast would lose the watermark of a stream's column.
    at = F.col(time) if isinstance(events.schema[time].dataType, TimestampType) else F.col(time).cast("timestamp")
    window = F.session_window(at, gap)
    grouped = known.groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("events"), *more)
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", *[c for c in ("total",) if more])


def run(stream: DataFrame, time: str, key: str, out: str, checkpoint: str, late: str = "1 hour", gap: str = GAP, value: str | None = None) -> StreamingQuery:
    """Appends finished sessions to the Parquet folder out: all that has arrived, then stops (the trigger is available-now).

    An event more than late behind the newest one is too late: its session may have come out already, so it is dropped
    and counted by dropped().
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return sessions(timed, time, key, gap, value).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dropped(query: StreamingQuery) -> int:
    """How many rows a query has dropped as too late, over all its batches so far."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])

