"""Running numbers within keys of any size, by a prefix sum on two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_count(df: DataFrame, keys: list[str], order: str, name: str, block: Column) -> DataFrame:
    """Adds the 1-based place of each row within its key, rows in rising `order`.

    `block` must rise with the order. Rows are numbered within (key, block); blocks are summed up apart, one row each.
    So a key that holds a third of all rows is as many windows as it has blocks, not one. `order` must be unique within
    a key, else the places of equal rows are taken in any order.
    """
    b = df.withColumn("__block", block)
    sums = b.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("__block").alias("__s_block"), before.alias("__before"))
    inner = F.row_number().over(W.partitionBy(*keys, "__block").orderBy(order))
    same = F.col("__block").eqNullSafe(F.col("__s_block"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    return b.withColumn("__i", inner).join(starts, same).withColumn(name, F.col("__before") + F.col("__i")).select(*df.columns, name)
