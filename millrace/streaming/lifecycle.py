"""Failure events as a stream: each fingerprint's count and state kept, what is to be told written to an outbox.

A batch is folded by the same expressions as the batch operators, in arrival order within a fingerprint: events are
numbered by prefix sums over blocks, so a fingerprint with a third of all events is many windows and never one group.
The state is a table of one small row a fingerprint, a folder for each batch; a batch that is replayed reads the state
before it and replaces its own rows, so nobody is told twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import incidents as I
from millrace.operators.numbering import running_count

STATE = "fingerprint string, state string, seen long, detected long, notified long"
OUT = "fingerprint string, delivery_id long, seen_count long, reason string, told boolean"
RESTARTS = ("new", "reopened")


def seconds(events: DataFrame) -> DataFrame:
    """Events with detected_at and received_at as epoch seconds; those without a fingerprint are left out."""
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return events.where("fingerprint IS NOT NULL").select("fingerprint", F.col("delivery_id").cast("long").alias("delivery_id"), at("detected_at").alias("detected"), F.coalesce(at("received_at"), F.lit(0)).alias("now"))


def _decide(state: Column, seen: Column, detected: Column, notified: Column) -> Column:
    t = F.timestamp_seconds
    return I.decide(state, seen, t(detected), t(notified), t(F.col("detected")), t(F.col("now")))


def fold_batch(events: DataFrame, stored: DataFrame, confirm: bool = False) -> DataFrame:
    """Each event (fingerprint, delivery_id, detected, now) with `n`, its number in the batch, `seen_count`, `reason`, `told`.

    stored is the state before the batch. The record starts anew at the first event that is new or reopens it; with
    `confirm`, the first event that is told counts as delivered at once, and what comes after it is not told.
    """
    block = F.floor(F.col("delivery_id") / I.BLOCK)
    rows = running_count(events, ["fingerprint"], "delivery_id", "n", block).withColumn("block", block)
    spots = ["fingerprint", "block"]  # small sides are joined by fingerprint and block, so that no fingerprint is one task
    held = rows.select(*spots).distinct().join(stored.select("fingerprint", F.col("state").alias("s0"), F.col("seen").alias("k0"), F.col("detected").alias("d0"), F.col("notified").alias("t0")), "fingerprint", "left")
    rows = rows.join(held, spots)
    before = F.coalesce("k0", F.lit(0)) + F.col("n") - 1
    anew = _decide(F.col("s0"), before, F.col("d0"), F.col("t0")).isin(*RESTARTS)
    first = rows.groupBy("fingerprint").agg(F.min(F.when(anew, F.col("n"))).alias("m"), F.min_by("detected", F.when(anew, F.col("n"))).alias("dm"))
    rows = rows.join(rows.select(*spots).distinct().join(first, "fingerprint"), spots)
    after = F.coalesce(F.col("n") > F.col("m"), F.lit(False))
    seen = F.when(after, F.col("n") - F.col("m")).otherwise(before)
    reason = _decide(F.when(after, "DETECTED").otherwise(F.col("s0")), seen, F.when(after, F.col("dm")).otherwise(F.col("d0")), F.when(~after, F.col("t0")))
    rows = rows.withColumn("reason", reason).withColumn("seen_count", F.when(F.col("reason").isin(*RESTARTS), 1).otherwise(seen + 1).cast("long")).withColumn("told", I.told(F.col("reason")))
    if confirm:
        said = rows.groupBy("fingerprint").agg(F.min(F.when(F.col("told"), F.col("n"))).alias("first_told"))
        rows = rows.join(rows.select(*spots).distinct().join(said, "fingerprint"), spots)
        late = F.coalesce(F.col("n") > F.col("first_told"), F.lit(False))
        rows = rows.withColumn("reason", F.when(late, "already_notified").otherwise(F.col("reason"))).withColumn("told", F.col("told") & ~late)
    return rows.select("fingerprint", "delivery_id", "seen_count", "reason", "told", "n", "detected", "now")


def next_state(folded: DataFrame, stored: DataFrame, confirm: bool = False, silent_before: int | None = None) -> DataFrame:
    """The state after a folded batch, by partial aggregates. silent_before: fingerprints unseen in this batch and last
    detected before that second are dropped."""
    anew, n = F.col("reason").isin(*RESTARTS), F.col("n")
    new = folded.groupBy("fingerprint").agg(F.max_by("seen_count", n).alias("k1"), F.max(F.when(anew, n)).alias("m"), F.max_by("detected", F.when(anew, n)).alias("d1"), F.max_by("now", F.when(F.col("told"), n)).alias("t1"), F.max("told").alias("told"))
    j = stored.join(new, "fingerprint", "full")
    kept = j if silent_before is None else j.where(F.col("k1").isNotNull() | (F.coalesce("notified", "detected", F.lit(silent_before)) >= silent_before))
    done = F.coalesce(F.col("told"), F.lit(False)) if confirm else F.lit(False)
    again = F.col("m").isNotNull()
    return kept.select("fingerprint", F.when(done, "NOTIFIED").when(again, "DETECTED").otherwise(F.col("state")).alias("state"), F.coalesce("k1", "seen").alias("seen"),
                       F.when(again, F.col("d1")).otherwise(F.col("detected")).alias("detected"), F.when(done, F.col("t1")).when(again, None).otherwise(F.col("notified")).alias("notified"))


def folding(spark: SparkSession, root: str, confirm: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: decisions into root/out/batch=N, the state after the batch into root/state/batch=N."""
    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        stored = s.read.schema(STATE).parquet(f"{root}/state/batch={batch_id - 1}") if batch_id else s.createDataFrame([], STATE)
        fold_batch(seconds(batch), stored, confirm).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        next_state(s.read.parquet(f"{root}/out/batch={batch_id}"), stored, confirm).write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    return write


def outbox(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: what is to be told, in a folder of the batch's own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where("told").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write
