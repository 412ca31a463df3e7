"""A database as a source: any reading statement pushed down, or a table split by a key."""

from __future__ import annotations

import os
import re
import shutil
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def query(spark: SparkSession, url: str, sql: str, properties: dict[str, str] | None = None, session_init: str | None = None, fetch: int = 10_000) -> DataFrame:
    """A statement run by the server; session_init is run first on each connection, such as a SET."""
    r = spark.read.format("jdbc").option("url", url).option("query", sql).option("fetchsize", fetch)
    if session_init:
        r = r.option("sessionInitStatement", session_init)
    return r.options(**(properties or {})).load()


def table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int, properties: dict[str, str] | None = None) -> DataFrame:
    """A table read by `parts` connections, each a range of a numeric key; filters and columns are pushed down."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
            .options(**(properties or {})).load())


def _cell(name: str):
    """A value as Derby's import reads it: in quotes, which tell an empty text from null."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.col(name).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def embedded(df: DataFrame, name: str, at: str) -> str:
    """Texts and numbers as a table of a new Derby database, an archive in the folder `at` that all machines mount; gives its URL, to read from.

    One process at a time may open a Derby database for writing, and one in memory is seen by no other process. So the executors
    write the rows as text, the driver alone imports them, and the database is read from an archive, which Derby opens without a lock.
    """
    jvm, root = df.sparkSession._jvm, re.sub("^file:/+", "/", at)
    if re.match(r"\w+:", root):
        raise ValueError(f"{at}: a database file needs a folder that all machines mount")
    root = os.path.abspath(root)
    df.select(F.concat_ws(",", *map(_cell, df.columns))).write.text(f"{at}/rows", compression="none")
    url = f"jdbc:derby:{root}/db"
    try:
        df.where("false").write.format("jdbc").option("url", f"{url};create=true").option("dbtable", name).save()  # no row, no task: only the driver connects
        c = jvm.java.sql.DriverManager.getConnection(url)
        for f in sorted(Path(root, "rows").glob("part-*")):
            c.createStatement().execute(f"""CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{name.upper()}', '{str(f).replace("'", "''")}', ',', '"', 'UTF-8', 0)""")
        c.close()
    finally:
        try:
            jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() not in ("08006", "XJ004"):  # it is shut down, it was never there
                raise
    shutil.rmtree(f"{root}/rows")
    with zipfile.ZipFile(f"{root}/db.jar", "w") as z:  # stored, so that a page is found by its place
        for f in Path(root, "db").rglob("*"):
            z.write(f, f.relative_to(root))
    shutil.rmtree(f"{root}/db")
    return f"jdbc:derby:jar:({root}/db.jar)db"
