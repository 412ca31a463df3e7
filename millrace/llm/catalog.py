"""Registry of this subpackage's queries and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import leakage, mojibake, packing, secrets, sourcefiles, split
from millrace.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of pieces over the limit."""
    return split.oversized_ids(load(spark, sf_dir, "chunks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indexed pieces within the limit, in reading order, numbered anew within the file."""
    return split.split_oversized(load(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on which a usable credential begins."""
    return secrets.scan(load(spark, sf_dir, "hits")).select("hit_id", "line_no").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its credentials masked and the rest of its text unchanged."""
    return secrets.redact(load(spark, sf_dir, "hits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in hits that no person wrote."""
    files = sourcefiles.judged_files(load(spark, sf_dir, "hits"), load(spark, sf_dir, "chunks"))
    return files.where(F.col("kind").isNotNull()).select("path_key")


def p4_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of files in hits without those that no person wrote."""
    files = sourcefiles.judged_files(load(spark, sf_dir, "hits"), load(spark, sf_dir, "chunks"))
    return files.where(F.col("kind").isNull()).select("path_key", "lines")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of every document, or of every piece of one that exceeds a container."""
    return packing.pack_texts(load(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space used by the packing: containers, tokens, share of the space that stays unused, the least possible share."""
    packed = packing.pack_texts(load(spark, sf_dir, "documents"))
    by = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    c = packing.CAPACITY
    return by.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
                  (1 - F.sum("tokens") / (F.count(F.lit(1)) * c)).alias("unused"), F.ceil(F.sum("tokens") / c).alias("least_containers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items, with the items."""
    return leakage.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents some of whose text was decoded with a wrong encoding."""
    return mojibake.restore(load(spark, sf_dir, "documents"), with_text=False).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the chains of encodings and the text restored wherever it can be."""
    return mojibake.restore(load(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_redacted": p2_redacted, "p4_found": p4_found, "p4_written": p4_written, "p6_packed": p6_packed, "p6_fill": p6_fill,
           "p7_found": p7_found, "p8_found": p8_found, "p8_restored": p8_restored}
ORACLES = {"p1_found": "SELECT DISTINCT id FROM chunks WHERE length(text) > 1200"}
