"""Queries that go through a source or a sink and come back: what is read again must be what SQL finds in the table itself.

Each writes into a folder of its own under the shared folder, then reads it by the source under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import text as T
from millrace.operators import checks as K
from millrace.plans import corpus as P
from millrace.plans.streams import run_available
from millrace.session import shared_folder
from millrace.sources import events as EV, jdbc, sqltext, tree
from millrace.sources.store import Store, index
from millrace.tables import load, register

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


def _payloads(spark: SparkSession, d: str) -> str:
    """The incidents' payloads as files of JSON lines."""
    at = folder(spark)
    load(spark, d, "incidents").where("mac_payload IS NOT NULL").select("mac_payload").write.text(at)
    return at


_EVENTS = "SELECT mac_payload->>'tool' AS tool, mac_payload->>'module' AS module, mac_payload->>'ts' AS ts, (mac_payload->>'returncode')::INT AS returncode FROM incidents WHERE mac_payload IS NOT NULL"


@query(_EVENTS)
def source_events(spark: SparkSession, d: str) -> DataFrame:
    """Raw events read from JSON lines with a stated schema."""
    return EV.read_json(spark, _payloads(spark, d)).select("tool", "module", "ts", "returncode")


@query(f"SELECT tool, count(*) AS n FROM ({_EVENTS}) GROUP BY 1")
def source_events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream, counted by tool."""
    return run_available(EV.stream_json(spark, _payloads(spark, d)).select("tool"), "append").groupBy("tool").agg(F.count("*").alias("n"))


@query(f"SELECT tool, module, ts FROM ({_EVENTS}) ORDER BY ts DESC NULLS LAST, tool, module LIMIT 50")
def source_events_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty, as a poll would fetch them."""
    e = EV.read_json(spark, _payloads(spark, d)).select("tool", "module", "ts")
    return EV.latest(e, 50, "tool", "module")


@query("SELECT item_id, md5(text || chr(10)) AS content, strlen(text) + 1 AS size FROM eval_items WHERE text IS NOT NULL")
def source_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of files, one a test item, scanned: names, sizes, contents."""
    at = folder(spark)
    load(spark, d, "eval_items").where("text IS NOT NULL").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(at)
    f = tree.scan(spark, at, "*.txt")
    return f.select(F.regexp_extract("rel_path", r"^item_id=(\d+)/", 1).cast("long").alias("item_id"), F.md5(F.col("content").cast("binary")).alias("content"), "size")


@query("SELECT DISTINCT rel_path FROM manifest WHERE (regexp_matches(split_part(rel_path, '/', -1), '^.*\\.py$') OR regexp_matches(split_part(rel_path, '/', -1), '^load_.*$')) AND NOT contains('/' || rel_path || '/', '/tests/') AND NOT contains('/' || rel_path || '/', 'page')")
def source_select(spark: SparkSession, d: str) -> DataFrame:
    """Files by name patterns, less a directory and a part of the path."""
    return tree.select_files(load(spark, d, "manifest"), ["*.py", "load_*"], ["tests/", "page"]).select("rel_path")


_IN = P.ORACLES["index_filters"].replace("SELECT collection, rel_path, size,", "SELECT DISTINCT rel_path, size,")
_SQL = "starts_with(rel_path, 'SQL-SCRIPTS/')"
_DOC = "NOT " + _SQL + " AND len(string_split(rel_path, '/')) <= 2 AND (upper(split_part(rel_path, '/', -1)) = 'README.MD' OR split_part(rel_path, '/', -1) IN (" + ", ".join(f"'{n}'" for n in T.DOC_NAMES) + "))"


@query(f"""WITH i AS ({_IN}) SELECT 'sql' AS collection, rel_path FROM i WHERE {_SQL} AND ends_with(rel_path, '.sql')
UNION ALL SELECT 'repos', rel_path FROM i WHERE NOT {_SQL} AND indexed UNION ALL SELECT 'docs', rel_path FROM i WHERE {_DOC} AND indexed""")
def source_collections(spark: SparkSession, d: str) -> DataFrame:
    """The collections every file belongs to."""
    return tree.collections(load(spark, d, "manifest").select("rel_path", "size").distinct()).select("collection", "rel_path")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def source_jdbc(spark: SparkSession, d: str) -> DataFrame:
    """A table of a database read by four connections, each a range of the key, with the filter pushed down."""
    url = jdbc.embedded(load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "customer", folder(spark))
    lo, hi = load(spark, d, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return jdbc.table(spark, url, "customer", "c_custkey", lo, hi, 4).where("c_acctbal > 0")


_SCRIPT = "-- two statements; the second is asked for\nSELECT 1 AS one;\n/* by nation; */ SELECT n_regionkey, count(*) AS n FROM nation WHERE n_name <> ';' GROUP BY n_regionkey"


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def source_sql_file(spark: SparkSession, d: str) -> DataFrame:
    """The second statement of an SQL file."""
    register(spark, d, "nation")
    return sqltext.run_read_only(spark, sqltext.split(_SCRIPT)[1])


@query("SELECT delivery_id, mac_payload->>'tool' AS tool FROM incidents WHERE mac_payload IS NOT NULL")
def source_fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON taken out of a text with a fence around it, or with words before and after it."""
    i = load(spark, d, "incidents").where("mac_payload IS NOT NULL")
    said = F.when(F.col("delivery_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("mac_payload"), F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("So: "), F.col("mac_payload"), F.lit(" and no more")))
    return i.select("delivery_id", EV.fenced_json(said, "tool string").tool.alias("tool"))


@query("SELECT module, repos_name FROM path_map")
def sink_tsv(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    EV.to_tsv(load(spark, d, "path_map").select("module", "repos_name"), at)
    return spark.read.option("sep", "\t").option("header", True).csv(at)


@query("SELECT item_id, id, query, collections FROM eval_items")
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark)
    x = load(spark, d, "eval_items").select("item_id", "id", "query", "collections")
    EV.to_json(x, at)
    return spark.read.schema(x.schema).json(at)


@query(P.ORACLES["keyed_upsert"])
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The manifest stored in buckets, then brought up to date: only the buckets that hold a changed file are written again."""
    s = Store(spark, folder(spark), ("collection", "rel_path"), 16)
    s.replace(load(spark, d, "manifest"))
    s.upsert(P._now(spark, d))
    return s.read()


@query(f"""WITH r AS (SELECT 'N/d' || doc_id || '.txt' AS path, {P._redacted("CASE WHEN doc_id % 10 = 1 THEN 'short' ELSE coalesce(text, '') END")} AS t FROM documents WHERE doc_id % 10 <> 0),
c AS (SELECT path, t, unnest(range(greatest(0, CAST(ceil((length(t) - 1200) / 1000.0) AS BIGINT)) + 1)) AS chunk FROM r)
SELECT path, chunk::INT AS chunk, md5(substr(t, chunk * 1000 + 1, 1200)) AS text FROM c""")
def store_index(spark: SparkSession, d: str) -> DataFrame:
    """All documents indexed as files, then again after a tenth of them were removed and a tenth shrank."""
    at = folder(spark)
    chunks, manifest = Store(spark, f"{at}/chunks", ("collection", "path"), 16), Store(spark, f"{at}/manifest", ("collection", "rel_path"), 16)
    f = P._notes(spark, d).withColumn("content", F.coalesce("content", F.lit(""))).withColumn("size", F.length("content").cast("long")).withColumn("mtime", F.lit(0).cast("long"))
    index(spark, f, chunks, manifest)
    n = F.regexp_extract("rel_path", r"(\d)\.txt$", 1)
    later = f.where(n != "0").withColumn("mtime", F.when(n == "1", 1).otherwise(0).cast("long")).withColumn("content", F.when(n == "1", "short").otherwise(F.col("content"))).withColumn("size", F.length("content").cast("long"))
    index(spark, later, chunks, manifest)
    return chunks.read().select("path", "chunk", F.md5("text").alias("text"))


@query("SELECT * FROM (VALUES ('nations', 'sql_rows', true), ('regions', 'sql_scalar', false)) t(id, kind, passed)")
def golden_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Cases kept as a table, those of one repository run."""
    register(spark, d, "nation", "region")
    cases = spark.createDataFrame([("nations", "R", "sql_rows", "SELECT * FROM nation", None, 25, 25), ("regions", "R", "sql_scalar", "SELECT count(*) FROM region", 6.0, None, None), ("other", "S", "sql_rows", "SELECT 1", None, None, None)],
                                  "id string, repo string, kind string, sql string, min_scalar double, min_rows int, max_rows int")
    return K.golden(spark, K.golden_cases(cases, "R")).select("id", "kind", "passed")
