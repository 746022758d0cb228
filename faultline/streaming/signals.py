"""Incremental counts of failing spans: a stream of spans, deduplicated within the watermark, counted by window and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "trace_id string, span_id string, kind string, status string, start_ns bigint"


def read_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans arriving as JSON lines in a landing folder."""
    return spark.readStream.schema(SPAN).json(folder)


def failing_by_window(spans: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window_start_us (epoch microseconds), kind, spans, failing. Works on streams and on tables; spans later than the watermark are dropped by Spark."""
    timed = spans.withColumn("event_time", F.timestamp_micros(F.floor(F.col("start_ns") / 1000)))
    if spans.isStreaming:
        timed = timed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["trace_id", "span_id"])
    else:
        timed = timed.dropDuplicates(["trace_id", "span_id"])
    counted = timed.groupBy(F.window("event_time", window).alias("w"), "kind").agg(F.count("*").alias("spans"), F.count(F.when(F.col("status") == "error", 1)).alias("failing"))
    return counted.select(F.unix_micros("w.start").alias("window_start_us"), "kind", "spans", "failing")
