"""A stated set held against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from millrace.session import cut_lineage


def each_block(spark: SparkSession, blocks: Iterable[Any], apply: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """What `apply` makes of every block, sent to the executors as a broadcast; None if there is no block.

    A single block stays a lazy plan. Of several, each one's result is written to the shared folder and its broadcast
    given back before the next block is fetched, so that one block at a time is in memory, on the driver as on executors.
    """
    out, held = None, None
    for block in blocks:
        if held is not None:
            out = _kept(out, apply(held))
            held.destroy()
        held = spark.sparkContext.broadcast(block)
    if held is None:
        return None
    if out is None:
        return apply(held)
    out = _kept(out, apply(held))
    held.destroy()
    return out


def _kept(out: DataFrame | None, part: DataFrame) -> DataFrame:
    part = cut_lineage(part)
    return part if out is None else out.unionByName(part)
