"""The audit log as table and stream. Streaming operators are an extension; each has a batch twin with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "ts timestamp, ecosystem string, package string, version string, decision string, severity string, action string, source string, advisory_id string, project_dir string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All whole lines of an append-only log of JSON lines; torn ones are skipped."""
    return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path)


def read_log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTRY).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def tail(log: DataFrame, n: int, order: str = "ts") -> DataFrame:
    """The last n entries."""
    return log.orderBy(F.col(order).desc()).limit(n)


def windowed_counts(log: DataFrame, key: str, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts by tumbling window and key; on a stream, state older than the watermark is dropped."""
    frame = log.withWatermark(ts, late) if log.isStreaming else log
    return frame.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(log: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions of a key: entries no further apart than a gap."""
    frame = log.withWatermark(ts, late) if log.isStreaming else log
    return frame.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def distinct_entries(log: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first of repeated entries (within the watermark, on a stream)."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if log.isStreaming else log.dropDuplicates(keys)
