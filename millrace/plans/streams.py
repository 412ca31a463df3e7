"""Streaming forms of event queries, run over what is there and read back; each must equal its batch form.

A stream writes through foreachBatch into the folder the session names for checkpoints, never into the driver.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.delivery import canonical_hash
from millrace.plans import relational
from millrace.plans.events import _HASH as HASH
from millrace.session import shared_folder
from millrace.streaming import lifecycle, windows
from millrace.tables import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, one file or a folder of files."""
    schema = load(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    if os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, mode: str, keys: tuple[str, ...] = (), sink: Callable[[str], Callable[[DataFrame, int], None]] | None = None) -> DataFrame:
    """Runs a stream over all that is available, into the shared folder. Each batch is a folder of its own, so a replayed
    batch replaces itself. In update mode the last batch that holds a key has its row; in complete mode the last batch is the
    result. sink: makes another foreachBatch writer, of root/out/batch=N, for a root."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(sink(root) if sink else write).start()
    q.awaitTermination()
    got = spark.read.option("basePath", out).parquet(out)
    if mode == "update":
        rest = [c for c in got.columns if c not in (*keys, "batch")]
        return got.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
    return got.drop("batch")


@query(relational.ORACLES["window_tumbling"])
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windows as they change; the watermark drops the state of those it has passed."""
    return run_available(windows.tumbling(windows.with_watermark(read_stream(spark, d, "events"), "30 days")), "update", ("start", "event_type"))


@query(relational.ORACLES["window_sliding"])
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return run_available(windows.sliding(windows.with_watermark(read_stream(spark, d, "events"), "30 days")), "update", ("start", "event_type"))


@query(relational.ORACLES["window_session"])
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions have no update mode, and append mode would hold back the last 30 days: here all of them are asked for at the end."""
    return run_available(windows.sessions(windows.with_watermark(read_stream(spark, d, "events"), "30 days")), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Each event id once; the watermark bounds the ids remembered."""
    return run_available(windows.dedupe(read_stream(spark, d, "events"), ["event_id"], "365 days").select("event_id"), "append")


@query(f"""WITH k AS (SELECT *, {HASH} AS h, epoch_us(detected_at) // 1000000 AS d, coalesce(epoch_us(received_at) // 1000000, 0) AS now FROM incidents),
n AS (SELECT *, row_number() OVER w AS n, first_value(d) OVER w AS d1 FROM k WHERE h IS NOT NULL WINDOW w AS (PARTITION BY h ORDER BY delivery_id))
SELECT h AS fingerprint, delivery_id, n AS seen_count, CASE WHEN n = 1 THEN 'new' WHEN n - 1 > 1 AND (n - 1) % 10 = 0 THEN 'renotify_count' WHEN (now - d1) / 3600.0 >= 24 THEN 'renotify_age' ELSE 'duplicate' END AS reason,
n = 1 OR n - 1 > 1 AND (n - 1) % 10 = 0 OR coalesce((now - d1) / 3600.0 >= 24, false) AS told FROM n""")
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery's decision by the state of its fingerprint, while nothing is confirmed."""
    e = read_stream(spark, d, "incidents").select(canonical_hash("fingerprint").alias("fingerprint"), "delivery_id", "detected_at", "received_at")
    return run_available(e, "append", sink=lambda root: lifecycle.folding(spark, root)).select("fingerprint", "delivery_id", "seen_count", "reason", "told")
