"""Raw failure events and result sinks: JSON lines in, rows and notifications out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.incidents import RAW


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines, with the schema stated rather than guessed."""
    return spark.read.schema(RAW).json(path)


def stream_json(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_a_batch).json(path)


def latest(events: DataFrame, n: int = 50, *ties: str) -> DataFrame:
    """The newest events, as a poll would fetch them, equal times in the order of `ties`; one ordered cut, no full sort."""
    return events.orderBy(F.desc_nulls_last("ts"), *ties).limit(n)


def from_payload(table: DataFrame, payload: str = "mac_payload", stderr: str = "raw_stderr_tail") -> DataFrame:
    """Events kept as JSON in a column, their stderr in another."""
    p = F.from_json(payload, RAW)
    return table.withColumn("__p", p).select(*[c for c in table.columns if c in ("delivery_id", "batch_id", "received_at")], *[F.col(f"__p.{f}").alias(f) for f in ("ts", "kind", "tool", "module", "returncode")],
                                             F.coalesce("__p.stderr", stderr).alias("stderr"), F.col("__p.stdout").alias("stdout"), F.col("__p.cwd").alias("cwd"), F.col("__p.argv").alias("argv"), F.col("__p.host").alias("host"))


def fenced_json(c: F.Column, schema: str) -> F.Column:
    """JSON inside a text: a fenced block, else the span from the first brace to the last, else null."""
    block = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    span = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(block != "", block).otherwise(span), schema)


def to_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
