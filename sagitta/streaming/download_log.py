"""The download log as a stream: events arrive as files and are appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import log_rows

EVENT_SCHEMA = "at timestamp, fmt string, row_count long, filters map<string, string>, email string, name string, ip string, user_agent string, referer string"


def events(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Events as JSON lines in files that arrive in ``path``."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_at_once).json(path)


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the stream to the log at ``path``, exactly once by the file sink's commits; ``once``: what is there now."""
    writer = log_rows(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def hourly_counts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``hour, fmt, downloads, rows`` of each hour, closed when events are ``late`` past it."""
    counted = stream.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "fmt").agg(F.count(F.lit(1)).alias("downloads"), F.sum("row_count").alias("rows"))
    return counted.select(F.col("w.start").alias("hour"), "fmt", "downloads", "rows")
