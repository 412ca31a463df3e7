"""Retrieval queries over hits, chunks, evaluation cases and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.functions import text as T
from millrace.operators import search as S
from millrace.session import shared_folder
from millrace.sources import events as EV
from millrace.tables import load

QUERIES, ORACLES = {}, {}

_KEY = "CASE WHEN coalesce(repo, '') = '' OR starts_with(path, repo || '/') THEN path ELSE repo || '/' || path END"
_INTENT = r"""CASE WHEN coalesce(intent, '') NOT IN ('', 'auto') THEN intent WHEN regexp_matches(query, '\b(discrepanc|inconsisten|mismatch|out of sync|contradict|doesn''?t match|drift)\b', 'i') THEN 'discrepancy' ELSE 'general' END"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def corpus(spark: SparkSession, d: str, *cols: str | Column) -> DataFrame:
    """The indexed pieces, repeated rows once. An id is made of collection, path and index, so rows of one id are equal in all
    columns, and whole rows can be made distinct by hash instead of sorting texts by id."""
    return load(spark, d, "chunks").select(*cols).distinct()


def cases(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "eval_items")
    kind = S.intent(F.col("query"), F.col("intent"))
    own = F.coalesce(F.size("collections"), F.lit(0)) > 0
    return c.withColumn("kind", kind).withColumn("route", F.when(own, F.col("collections")).otherwise(S.routed(kind, F.col("query"))))


@query(f"""WITH i AS (SELECT item_id, query, {_INTENT} AS kind FROM eval_items),
r AS (SELECT item_id, kind, CASE kind WHEN 'discrepancy' THEN ['discrepancies', 'docs', 'repos'] WHEN 'incident' THEN ['playbooks', 'docs', 'repos']
  ELSE CASE WHEN regexp_matches(query, '\\b(sql|schema|mysql|table|database|column|migration|ddl)\\b', 'i') THEN ['repos', 'docs', 'sql'] ELSE ['repos', 'docs'] END END AS route FROM i)
SELECT item_id, kind AS intent, unnest(range(len(route))) AS pos, unnest(route) AS collection, greatest(2, 8 // len(route) + 1) AS fan_out FROM r""")
def intent_route(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "eval_items")
    kind = S.intent(F.col("query"), F.col("intent"))
    c = c.select("item_id", kind.alias("kind"), S.routed(kind, F.col("query")).alias("route"))
    return c.select("item_id", F.col("kind").alias("intent"), F.posexplode("route").alias("pos", "collection"), S.per_collection(S.TOP_K, F.size("route")).alias("fan_out"))


@query("""SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 8""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings")
    return S.vector_topk(v, v.where("vec_id % 100 = 0"))


_STATS = r"""WITH c AS (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id),
w AS (SELECT collection, id, list_filter(regexp_split_to_array(lower(text), '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM c),
n AS (SELECT collection, count(*) AS n_docs, avg(len(w)) AS avgdl FROM w GROUP BY 1),
f AS (SELECT collection, term, count(*) AS df FROM (SELECT collection, unnest(list_distinct(w)) AS term FROM w) GROUP BY 1, 2),
raw AS (SELECT f.*, n_docs, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf0 FROM f JOIN n USING (collection)),
m AS (SELECT collection, avg(idf0) AS mean_idf FROM raw GROUP BY 1),
t AS (SELECT raw.*, CASE WHEN idf0 < 0 THEN 0.25 * mean_idf ELSE idf0 END AS idf FROM raw JOIN m USING (collection))
"""


@query(_STATS + "SELECT collection, term, df, round(idf, 6) AS idf FROM t")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus_stats(corpus(spark, d, "id", "collection", "text"))[1].withColumn("idf", F.round("idf", 6))


_SCORES = _STATS + r""", q AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(query), '[\s\x0B\x{85}\p{Z}]+'), lambda x: x <> '')) AS term FROM eval_items) GROUP BY 1, 2),
tf AS (SELECT collection, id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT collection, id, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
s AS (SELECT item_id AS query_id, tf.collection, id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN t ON t.collection = tf.collection AND t.term = tf.term GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 24)
"""


@query(_SCORES + "SELECT query_id, collection, id, score, rank FROM b")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_topk(corpus(spark, d, "id", "collection", "text"), load(spark, d, "eval_items")).select("query_id", "collection", "id", "score", "rank")


_RANKS = f"""WITH h AS (SELECT query_id, collection, {_KEY} AS path_key, chunk, min(pos::BIGINT * 1000000000 + hit_id) AS p, min(coalesce(distance, 1.0)) AS d FROM hits GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, p) - 1 AS rv, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS rl FROM h)
"""


@query(_RANKS + "SELECT query_id, collection, path_key, chunk, round(0.7 / (60 + rv + 1) + 0.3 / (60 + rl + 1), 9) AS rrf_score FROM r")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """The list by distance fused with the list as it was logged, for every logged query."""
    h = load(spark, d, "hits").withColumn("path_key", T.path_key(F.col("repo"), F.col("path")))
    keys = ["collection", "path_key", "chunk"]
    h = h.groupBy("query_id", *keys).agg(F.min(F.struct("pos", "hit_id")).alias("p"), F.min(F.coalesce("distance", F.lit(1.0))).alias("d"))
    w = W.partitionBy("query_id")
    by_distance = h.withColumn("rank0", F.row_number().over(w.orderBy("d", "p")) - 1)
    as_logged = h.withColumn("rank0", F.row_number().over(w.orderBy("p")) - 1)
    return S.rrf(by_distance, as_logged, keys).withColumn("rrf_score", F.round("rrf_score", 9))


_FILTERED = f"""WITH h AS (SELECT *, coalesce(distance, 1.0) AS d, {_KEY} AS path_key FROM hits),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, pos, hit_id) AS f, count(*) FILTER (d <= 0.85) OVER (PARTITION BY query_id) AS near FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, path_key ORDER BY d, pos, hit_id) AS o FROM g WHERE d <= 0.85 OR (near = 0 AND f = 1)),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, pos, hit_id) AS rank, count(*) FILTER (d <= 0.4) OVER (PARTITION BY query_id) AS strong FROM c WHERE o <= 1),
k AS (SELECT * FROM l WHERE rank <= CASE WHEN strong >= 3 THEN 3 ELSE 6 END)
"""


@query(_FILTERED + "SELECT query_id, hit_id, path_key, d AS distance, rank FROM k")
def context_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.filter_context(load(spark, d, "hits").drop("text")).select("query_id", "hit_id", "path_key", F.col("d").alias("distance"), "rank")


@query(_FILTERED + """, b AS (SELECT query_id, rank, '### [' || collection || '] ' || path_key || ' (chunk ' || chunk || ')' || chr(10) || substr(coalesce(text, ''), 1,
CAST(CASE WHEN d <= 0.4 THEN 900 WHEN d >= 0.85 THEN 225 ELSE greatest(120, trunc(900 * (1.0 - 0.75 * ((d - 0.4::DOUBLE) / (0.85::DOUBLE - 0.4::DOUBLE))))) END AS INTEGER)) AS b FROM k),
u AS (SELECT query_id, b, min(rank) AS rank FROM b GROUP BY 1, 2)
SELECT query_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS context_md5, CAST(sum(length(b)) + 2 * (count(*) - 1) AS BIGINT) AS chars, count(*) AS blocks FROM u GROUP BY 1""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    c = S.context_block(S.filter_context(load(spark, d, "hits")))
    return c.select("query_id", F.md5(F.col("context")).alias("context_md5"), F.length("context").alias("chars"), "blocks")


def retrieved(spark: SparkSession, d: str, k: int = S.TOP_K) -> DataFrame:
    """Lexical retrieval of every case at once: routed collections, their fan-out, nearest first, cut at k."""
    found = S.bm25_topk(corpus(spark, d, "id", "collection", "text"), load(spark, d, "eval_items"))
    route = cases(spark, d).select(F.col("item_id").alias("query_id"), F.posexplode("route").alias("col_pos", "collection"), S.per_collection(k, F.size("route")).alias("fan_out"))
    kept = found.join(F.broadcast(route), ["query_id", "collection"]).where("rank <= fan_out").withColumn("distance", F.round(1.0 / (1.0 + F.col("score")), 6))
    w = W.partitionBy("query_id").orderBy("distance", "col_pos", "rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


_HYBRID = _SCORES + f""", e AS (SELECT *, {_INTENT} AS kind FROM eval_items),
ro AS (SELECT item_id AS query_id, query, nullif(repo, '') AS scope, CASE WHEN len(collections) > 0 THEN collections WHEN kind = 'discrepancy' THEN ['discrepancies', 'docs', 'repos'] WHEN kind = 'incident' THEN ['playbooks', 'docs', 'repos']
  WHEN regexp_matches(query, '\\b(sql|schema|mysql|table|database|column|migration|ddl)\\b', 'i') THEN ['repos', 'docs', 'sql'] ELSE ['repos', 'docs'] END AS route FROM e),
p AS (SELECT query_id, scope, unnest(range(len(route))) AS col_pos, unnest(route) AS collection, greatest(2, 8 // len(route) + 1) AS fan_out FROM ro),
cb AS (SELECT id, b, count(*)::DOUBLE AS x FROM (SELECT id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b FROM (SELECT id, unnest(w) AS term FROM w)) GROUP BY 1, 2), cn AS (SELECT id, sqrt(sum(x * x)) AS n FROM cb GROUP BY 1),
qb AS (SELECT item_id AS query_id, b, sum(qn)::DOUBLE AS x FROM (SELECT item_id, qn, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b FROM q) GROUP BY 1, 2), qm AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qb GROUP BY 1),
dot AS (SELECT query_id, id, sum(qb.x * cb.x) AS d FROM qb JOIN cb USING (b) GROUP BY 1, 2),
pr AS (SELECT p.query_id, p.col_pos, p.collection, p.fan_out, c.id, c.kind, round(1 - coalesce(d, 0) / (qm.n * cn.n), 6) AS raw FROM p JOIN qm USING (query_id) JOIN c ON c.collection = p.collection AND (c.collection <> 'sql' OR c.repo = 'SQL-SCRIPTS')
  AND (scope IS NULL OR c.collection NOT IN ('repos', 'docs') OR c.repo IS NULL OR c.repo = scope) JOIN cn ON cn.id = c.id LEFT JOIN dot ON dot.query_id = p.query_id AND dot.id = c.id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY raw, id) AS vrank FROM pr QUALIFY vrank <= fan_out),
vl AS (SELECT *, round(raw / CASE WHEN kind IN ('readme', 'doc') THEN 1.35::DOUBLE WHEN kind = 'discrepancy' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY col_pos, vrank) - 1 AS r0 FROM vr),
ll AS (SELECT b.query_id, b.collection, b.id, round(1.0 / (1.0 + score), 6) AS distance, row_number() OVER (PARTITION BY b.query_id ORDER BY col_pos, rank) - 1 AS r0 FROM b JOIN p ON p.query_id = b.query_id AND p.collection = b.collection),
u AS (SELECT query_id, collection, id, distance, r0 AS ord, 0.7::DOUBLE / (r0 + 61) AS s, 0 AS lex FROM vl UNION ALL SELECT query_id, collection, id, distance, r0 + 1048576, (1 - 0.7::DOUBLE) / (r0 + 61), 1 FROM ll),
o AS (SELECT query_id, collection, id, round(sum(s), 9) AS rrf, min(ord) AS ord, arg_min(distance, ord) AS distance, max(lex) AS lex FROM u GROUP BY 1, 2, 3),
fu AS (SELECT *, max(lex) OVER (PARTITION BY query_id) = 1 AS fused FROM o),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fused THEN -rrf ELSE distance END, ord) AS place FROM fu QUALIFY place <= 8)
"""


def with_vectors(x: DataFrame, text: str) -> DataFrame:
    return x.withColumn("vec", S.hash_embedding(F.coalesce(text, F.lit(""))))


@query(_HYBRID + "SELECT query_id, place, collection, id, distance, CASE WHEN fused THEN rrf END AS rrf_score FROM pl")
def retrieve_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation case through the whole of retrieval: routing, vectors, words, fusion, boosts, documents of its repository."""
    q = cases(spark, d).select(F.col("item_id").alias("query_id"), "query", "route", "repo")
    return S.retrieve(with_vectors(corpus(spark, d, "id", "collection", "repo", "kind", "text"), "text"), with_vectors(q, "query"), hybrid=True)


@query(_HYBRID.replace(" UNION ALL SELECT query_id, collection, id, distance, r0 + 1048576, (1 - 0.7::DOUBLE) / (r0 + 61), 1 FROM ll", "")
       + "SELECT query_id, place, collection, id, distance FROM pl")
def retrieve_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same without the lexical side: by boosted distance."""
    q = cases(spark, d).select(F.col("item_id").alias("query_id"), "query", "route", "repo")
    return S.retrieve(with_vectors(corpus(spark, d, "id", "collection", "repo", "kind", "text"), "text"), with_vectors(q, "query"), hybrid=False).drop("rrf_score")


_CASES = _SCORES + f""", e AS (SELECT *, {_INTENT} AS kind FROM eval_items),
ro AS (SELECT *, CASE WHEN len(collections) > 0 THEN collections WHEN kind = 'discrepancy' THEN ['discrepancies', 'docs', 'repos'] WHEN kind = 'incident' THEN ['playbooks', 'docs', 'repos']
  WHEN regexp_matches(query, '\\b(sql|schema|mysql|table|database|column|migration|ddl)\\b', 'i') THEN ['repos', 'docs', 'sql'] ELSE ['repos', 'docs'] END AS route FROM e),
p AS (SELECT item_id AS query_id, unnest(range(len(route))) AS col_pos, unnest(route) AS collection, greatest(2, 8 // len(route) + 1) AS fan_out FROM ro),
x AS (SELECT b.*, col_pos, round(1.0 / (1.0 + score), 6) AS distance FROM b JOIN p USING (query_id, collection) WHERE rank <= fan_out),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, col_pos, rank) AS place FROM x QUALIFY place <= 8),
z AS (SELECT ro.item_id, any_value(coalesce(expect_path_contains, '')) AS expect, count(y.id) AS hit_count, min(y.distance) AS top_distance,
  coalesce(bool_or(coalesce(expect_path_contains, '') <> '' AND (contains(lower(coalesce(c.repo, '') || '/' || c.path), lower(expect_path_contains)) OR
  (NOT coalesce(match_path_only, false) AND contains(lower(substr(c.text, 1, 200)), lower(expect_path_contains))))), false) AS ok
  FROM ro LEFT JOIN y ON y.query_id = ro.item_id LEFT JOIN c ON c.id = y.id GROUP BY 1)
"""


@query(_CASES + "SELECT item_id, ok, expect, hit_count, top_distance FROM z")
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """One row a case: whether a retrieved piece is the expected one. All cases are one plan."""
    best = retrieved(spark, d)
    pieces = corpus(spark, d, "id", "repo", "path", F.substring("text", 1, 200).alias("text"))
    found = best.join(pieces, "id")  # 8 rows a case meet the corpus; only ids and heads of texts are read
    c = load(spark, d, "eval_items").select("item_id", F.coalesce("expect_path_contains", F.lit("")).alias("expect"), "match_path_only")
    rows = c.join(found.withColumnRenamed("query_id", "item_id"), "item_id", "left")
    ok = S.matches(F.col("expect"), F.col("repo"), F.col("path"), F.col("text"), F.col("match_path_only"))
    return rows.groupBy("item_id").agg(F.coalesce(F.bool_or(F.col("id").isNotNull() & ok), F.lit(False)).alias("ok"), F.first("expect").alias("expect"), F.count("id").alias("hit_count"), F.min("distance").alias("top_distance"))


@query(_CASES + "SELECT count(*) FILTER (ok) AS passed, count(*) AS total, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (ok) / count(*) END AS rate, coalesce(count(*) FILTER (ok) / count(*), 0) >= 0.7 AS reached FROM z")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    r = eval_cases(spark, d).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))
    rate = F.coalesce(F.try_divide(F.col("passed").cast("double"), "total"), F.lit(0.0))
    return r.select("passed", "total", rate.alias("rate"), (rate >= S.RECALL_THRESHOLD).alias("reached"))


# --- contexts of what was retrieved --------------------------------------------------------------------------------------

_VECTORS = _HYBRID.replace(" UNION ALL SELECT query_id, collection, id, distance, r0 + 1048576, (1 - 0.7::DOUBLE) / (r0 + 61), 1 FROM ll", "")
_BLOCKS = _FILTERED.replace("WITH h AS", ", h AS").replace("FROM hits)", "FROM got)").replace("c AS (", "ca AS (").replace("FROM c WHERE o", "FROM ca WHERE o") + """, bl AS (SELECT query_id, rank, '### [' || collection || '] ' || path_key || ' (chunk ' || chunk || ')' || chr(10) || substr(coalesce(text, ''), 1,
CAST(CASE WHEN d <= 0.4 THEN 900 WHEN d >= 0.85 THEN 225 ELSE greatest(120, trunc(900 * (1.0 - 0.75 * ((d - 0.4::DOUBLE) / (0.85::DOUBLE - 0.4::DOUBLE))))) END AS INTEGER)) AS b FROM k),
ub AS (SELECT query_id, b, min(rank) AS rank FROM bl GROUP BY 1, 2), co AS (SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS blocks FROM ub GROUP BY 1)
"""
_GOT = ", got AS (SELECT pl.query_id, place AS pos, pl.id AS hit_id, c.repo, c.path, c.chunk, pl.distance, c.collection, c.text FROM pl JOIN c ON c.id = pl.id)"
_EVALUATED = _VECTORS + _GOT + _BLOCKS + """, ok AS (SELECT query_id, bool_or(coalesce(expect_path_contains, '') <> '' AND (contains(lower(coalesce(got.repo, '') || '/' || got.path), lower(expect_path_contains)) OR
  (NOT coalesce(match_path_only, false) AND contains(lower(substr(got.text, 1, 200)), lower(expect_path_contains))))) AS ok, count(*) AS hits, min(distance) AS top FROM got JOIN eval_items ON item_id = query_id GROUP BY 1),
ev AS (SELECT item_id, coalesce(ok, false) AS ok, coalesce(hits, 0) AS hit_count, top AS top_distance, coalesce(length(context), 0) AS context_chars, coalesce(blocks, 0) AS context_chunks FROM eval_items LEFT JOIN ok ON ok.query_id = item_id LEFT JOIN co ON co.query_id = item_id)
"""


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return with_vectors(corpus(spark, d, "id", "collection", "repo", "path", "chunk", "kind", "text"), "text")


@query(_EVALUATED + "SELECT item_id, ok, hit_count, top_distance, context_chars, context_chunks FROM ev")
def eval_context(spark: SparkSession, d: str) -> DataFrame:
    """One row a case of a whole evaluation: found or not, and how long a context its pieces make."""
    c = pieces(spark, d)
    got = S.retrieve(c, with_vectors(cases(spark, d).select(F.col("item_id").alias("query_id"), "query", "route", "repo"), "query"), hybrid=False)
    hits = got.select("query_id", F.col("place").alias("pos"), F.col("id").alias("hit_id"), "distance").join(c.select(F.col("id").alias("hit_id"), "collection", "repo", "path", "chunk", "text"), "hit_id")
    made = S.context_block(S.filter_context(hits)).select("query_id", F.length("context").alias("context_chars"), F.col("blocks").alias("context_chunks"))
    e = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "expect_path_contains", "match_path_only")
    right = S.matches(F.col("expect_path_contains"), F.col("repo"), F.col("path"), F.col("text"), F.col("match_path_only"))
    found = hits.join(e, "query_id").groupBy("query_id").agg(F.bool_or(right).alias("ok"), F.count("*").alias("hit_count"), F.min("distance").alias("top_distance"))
    rows = e.select("query_id").join(found, "query_id", "left").join(made, "query_id", "left")
    return rows.select(F.col("query_id").alias("item_id"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "top_distance",
                       F.coalesce("context_chars", F.lit(0)).alias("context_chars"), F.coalesce("context_chunks", F.lit(0)).alias("context_chunks"))


@query(_EVALUATED + "SELECT count(*) FILTER (ok) AS passed, count(*) AS total, count(*) FILTER (ok) / count(*) AS rate, round(avg(context_chars), 6) AS avg_context_chars FROM ev")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation in one row, written as JSON and read again."""
    at = f"{shared_folder(spark)}/eval-{uuid.uuid4().hex}"
    r = eval_context(spark, d).agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.avg(F.col("ok").cast("double")).alias("rate"), F.round(F.avg("context_chars"), 6).alias("avg_context_chars"))
    EV.to_json(r, at)
    return spark.read.schema(r.schema).json(at)


_FIX = (_VECTORS.replace("WITH c AS", """WITH rq AS (SELECT item_id, coalesce(query, '') AS request, repo, CASE WHEN intent = 'incident' THEN 'x' END AS incident FROM eval_items),
fk AS (SELECT *, CASE WHEN incident <> '' THEN 'incident' WHEN regexp_matches(request, '\\b(discrepanc|inconsisten|mismatch|out of sync|contradict|doesn''t match|doesnt match|drift)\\b', 'i') THEN 'discrepancy' WHEN """ + " OR ".join(f"contains(lower(request), '{w}')" for w in T.DRIFT_WORDS) + """ THEN 'discrepancy' ELSE 'general' END AS intent FROM rq),
fx AS (SELECT item_id * 2 AS item_id, substr(request, 1, 500) AS query, repo, intent, NULL::VARCHAR[] AS collections FROM fk UNION ALL SELECT item_id * 2 + 1, 'entry point related to: ' || substr(request, 1, 200), repo, intent, NULL FROM fk),
c AS""", 1).replace("FROM eval_items", "FROM fx").replace("coalesce(query, '') AS request, repo, CASE WHEN intent = 'incident' THEN 'x' END AS incident FROM fx", "coalesce(query, '') AS request, repo, CASE WHEN intent = 'incident' THEN 'x' END AS incident FROM eval_items")
        .replace("8 // len(route)", "4 // len(route)").replace("QUALIFY place <= 8", "QUALIFY place <= 4"))


@query(_FIX + _GOT.replace("SELECT pl.query_id, place AS pos", "SELECT pl.query_id // 2 AS query_id, pl.query_id % 2 * 4 + place AS pos") + _BLOCKS + "SELECT query_id AS request_id, md5(context) AS context_md5, blocks FROM co")
def retrieve_for_fix(spark: SparkSession, d: str) -> DataFrame:
    """The context of a change request, each evaluation question taken for one: two phrasings, their pieces together."""
    r = load(spark, d, "eval_items").select(F.col("item_id").alias("request_id"), F.col("query").alias("request"), "repo", F.when(F.col("intent") == "incident", "x").alias("incident"))
    return S.fix_context(pieces(spark, d), r, S.hash_embedding).select("request_id", F.md5("context").alias("context_md5"), "blocks")
