"""A tree of files as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import corpus as C


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(rel_path, size, mtime, content): every file under root as UTF-8, undecodable bytes replaced. Lazy: content is read only if used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    f = (r.option("pathGlobFilter", glob) if glob else r).load(root)
    rel = F.regexp_replace(F.col("path"), r"^(file:)?/*" + _literal(root.strip("/")) + "/", "")
    return f.select(rel.alias("rel_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), _utf8("content").alias("content"))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def _utf8(c: str) -> Column:
    """Bytes as text with replacement of what is no UTF-8; a strict decoder would fail the row."""
    return F.col(c).cast("string")


def collections(files: DataFrame, repo: str | None = None, excluded: tuple[str, ...] = C.EXCLUDED) -> DataFrame:
    """Files with the collections they belong to: code, documents of the first rank, the SQL tree."""
    f = files if repo is None else files.where(F.split("rel_path", "/")[0] == repo)
    p = F.col("rel_path")
    sql = (C.collection(p) == "sql") & p.endswith(".sql")
    where = F.array_compact(F.array(F.when(sql, "sql"), F.when((C.collection(p) == "repos") & C.indexable(p, F.col("size"), excluded), "repos"), F.when((C.collection(p) == "repos") & C.is_doc(p) & C.indexable(p, F.col("size"), excluded), "docs")))
    return f.select(F.explode(where).alias("collection"), "*")


def manifest(files: DataFrame) -> DataFrame:
    """Signatures of files."""
    return files.select("collection", "rel_path", "mtime", "size", C.file_hash(F.col("content")).alias("hash"))


def select_files(files: DataFrame, globs: list[str], excludes: list[str]) -> DataFrame:
    """Files by name patterns, less the excluded ones (a directory with its slash, a part of the path, a name), sorted."""
    name = F.substring_index("rel_path", "/", -1)
    wanted = F.lit(False)
    for g in globs:
        wanted = wanted | name.rlike("^" + g.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$")
    for x in excludes:
        if x:
            wanted = wanted & ~F.concat(F.lit("/"), F.col("rel_path"), F.lit("/")).contains("/" + x if x.endswith("/") else x)
    return files.where(wanted).dropDuplicates(["rel_path"]).orderBy("rel_path")
