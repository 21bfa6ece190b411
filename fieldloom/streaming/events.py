"""Event streams: the same groupings on Structured Streaming, with watermarks for late rows.

An addition for unbounded inputs; batch tables go through the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """window_start, kind, cnt, total by window of fixed width."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width), kind).agg(F.count("*").alias("cnt"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), kind, "cnt", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """user, session_start, session_end, cnt: runs of events less than a gap apart."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("cnt"))
    return out.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "cnt")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now to Parquet, exactly once, and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
