"""Queries of the two general problems: log entries (3) and repeated deliveries (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import delivery, logparse
from millrace.tables import load


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each log entry begins, with its timestamp, level and component."""
    return logparse.parse_logs(load(spark, sf_dir, "incidents"), with_message=False)


def p3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log entry with its whole message."""
    return logparse.parse_logs(load(spark, sf_dir, "incidents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repeated delivery beside the first of the same message."""
    rows = load(spark, sf_dir, "incidents").select("delivery_id", "fingerprint", "detected_at")
    return delivery.repeats(rows, delivery.message_key(), "delivery_id").select(F.col("first").alias("first_delivery_id"), F.col("repeat").alias("delivery_id"))


def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message once: the incidents without their repeats."""
    return (delivery.keep_one(load(spark, sf_dir, "incidents"), delivery.message_key(), "delivery_id")
            .select("delivery_id", "batch_id", "fingerprint", "source", "tool", "module", "severity", "kind", "returncode", "state", "seen_count"))


_KEYED = r"""
WITH k AS (SELECT *, nullif(regexp_replace(lower(regexp_replace(fingerprint, '\s+', '', 'g')), '^sha256:', ''), '') AS h FROM incidents),
r AS (SELECT *, min(delivery_id) OVER (PARTITION BY h, detected_at) AS first_id FROM k WHERE h IS NOT NULL AND detected_at IS NOT NULL)
"""

QUERIES = {"p3_found": p3_found, "p3_entries": p3_entries, "p5_found": p5_found, "p5_messages": p5_messages}
ORACLES = {
    "p5_found": _KEYED + "SELECT first_id AS first_delivery_id, delivery_id FROM r WHERE delivery_id > first_id",
    "p5_messages": _KEYED + """SELECT delivery_id, batch_id, fingerprint, source, tool, module, severity, kind, returncode, state, seen_count FROM k
WHERE delivery_id NOT IN (SELECT delivery_id FROM r WHERE delivery_id > first_id)""",
}
