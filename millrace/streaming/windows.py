"""Event-time windows that read alike on tables and streams; on a stream they need `with_watermark` first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_watermark(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events with a zoned timestamp and a bound on lateness; rows later than that are dropped by stateful steps."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _ntz(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz")


def tumbling(events: DataFrame, width: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    n = events.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(_ntz("w.start").alias("start"), key, "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    n = events.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(F.window(ts, width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(_ntz("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    n = events.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, _ntz("w.start").alias("start"), _ntz("w.end").alias("end"), "n")


def dedupe(events: DataFrame, keys: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each key once within the watermark, with state bounded by it."""
    return with_watermark(events, delay, ts).dropDuplicatesWithinWatermark(keys)
