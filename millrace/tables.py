"""Loading the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "hits", "chunks", "manifest", "incidents", "path_map", "eval_items")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temp views under the tables' own names, for SQL texts."""
    for n in names or NAMES:
        load(spark, sf_dir, n).createOrReplaceTempView(n)
