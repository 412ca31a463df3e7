"""At-least-once deliveries: keep one copy of each message, list the repeats.

Identifiers are split by their aggregated frequency. Keys seen once pass straight through; only keys seen
more often are ranked, and both results are united. The ranking asks for rank 1 only, so Spark's window group
limit cuts each map task to one row a key before the shuffle: a key that holds a third of all rows costs no
task more than any other. Keys that alone hold more than one row in HOT_SHARE of all (so fewer than HOT_SHARE
keys, whatever the size of the table) never enter the shuffle join that ties rows to their key's frequency: their
frequencies are broadcast.

Defined results: rows whose key has a null part are messages of their own and pass unchanged; of rows with the
smallest order value one is kept; an empty table gives an empty table; other columns, whatever their names, are
carried along untouched in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_SHARE = 1000


def canonical_hash(c: Column | str) -> Column:
    """One spelling per hash: white space, an algorithm prefix and the case of the digits do not matter.

    Null and blank texts give null; a text that is no hash is compared trimmed and in lower case.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", "")), r"^(sha-?(256|512|1)|md5|0x)[:=\-]?(?=[0-9a-f]{8})", "")
    return F.when(bare != "", bare)


def message_key() -> dict[str, Column]:
    """What tells one failure message from another."""
    return {"hash": canonical_hash("fingerprint"), "at": F.col("detected_at")}


def _keyed(df: DataFrame, keys: dict[str, Column], order: str, whole: bool) -> tuple[DataFrame, list[str]]:
    """(row, at, key columns): the rest of a row travels in one struct, where its names clash with nothing."""
    names = [f"k{i}" for i in range(len(keys))]
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] * whole
    return df.select(*row, F.col(order).alias("at"), *[e.alias(n) for n, e in zip(names, keys.values())]), names


def frequencies(keyed: DataFrame, names: list[str]) -> DataFrame:
    """Rows and first order value of each complete key; the partial aggregate keeps hot keys to a row a task."""
    return keyed.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def _tagged(keyed: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete key and its n and first: those of ordinary keys, and those of hot ones."""
    freq = frequencies(keyed, names)
    total = freq.agg(F.sum("n")).scalar()
    hot = F.broadcast(freq.where((F.col("n") * HOT_SHARE > total) & (F.col("n") > 1)))
    cold = freq.where((F.col("n") * HOT_SHARE <= total) | (F.col("n") == 1))
    return keyed.join(hot.select(*names), names, "left_anti").join(cold, names), keyed.join(hot, names)


def keep_one(df: DataFrame, keys: dict[str, Column], order: str) -> DataFrame:
    """Each message once, the row with the smallest order value; rows with an incomplete key all stay."""
    keyed, names = _keyed(df, keys, order, True)
    cold, hot = _tagged(keyed, names)
    first = F.row_number().over(Window.partitionBy(*names).orderBy(F.col("at").asc_nulls_last()))
    ranked = cold.where("n > 1").unionByName(hot).withColumn("place", first).where("place = 1")
    broken = keyed.where(" OR ".join(f"{n} IS NULL" for n in names))
    return cold.where("n = 1").select("row").unionByName(ranked.select("row")).unionByName(broken.select("row")).select("row.*")


def repeats(df: DataFrame, keys: dict[str, Column], order: str) -> DataFrame:
    """(first, repeat): order value of each delivery ranked after the first of its message, beside that first one.

    Deliveries that share the first one's order value are no repeats of it; nor is one without an order value.
    """
    keyed, names = _keyed(df, keys, order, False)
    cold, hot = _tagged(keyed, names)
    return cold.where("n > 1").unionByName(hot).where("at > first").select("first", F.col("at").alias("repeat"))


def merge_new(stored: DataFrame, new: DataFrame, keys: dict[str, Column], order: str) -> DataFrame:
    """Stored and newly arrived messages as one table with each message once; a stored copy wins as the earlier one."""
    return keep_one(stored.unionByName(new, allowMissingColumns=True), keys, order)
