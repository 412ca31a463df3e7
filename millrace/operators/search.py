"""Retrieval: exact vector and lexical top-k, rank fusion, hybrid retrieval, context selection, recall.

A query set is held against all rows in blocks: each block of at most BLOCK_QUERIES queries is broadcast once, every
task keeps the best k of its own rows for each query, and only those cross the shuffle. No pairs of query and row are
ever materialised beyond a slice of SLICE scores; several blocks follow one after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from millrace.functions import text as T
from millrace.operators.blocks import each_block
from millrace.session import cut_lineage

# Retrieval constants.
TOP_K, LEXICAL_K, RRF_K, VECTOR_WEIGHT = 8, 24, 60, 0.7
MAX_DISTANCE, STRONG_DISTANCE, EARLY_STOP, MAX_CHUNKS, MAX_CHARS, PER_PATH = 0.85, 0.40, 3, 6, 900, 1
DOC_BOOST, FINDING_BOOST, RECALL_THRESHOLD = 1.35, 1.25, 0.7
# Okapi constants.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
# Routing patterns and collections by intent. Two stems never match alone; strict_stems=False lets them.
DISCREPANCY = r"(?iU)\b(discrepanc|inconsisten|mismatch|out of sync|contradict|doesn'?t match|drift)\b"
DISCREPANCY_STEMS = r"(?iU)\b(discrepanc\w*|inconsisten\w*|mismatch|out of sync|contradict|doesn'?t match|drift)\b"
DATABASE = r"(?iU)\b(sql|schema|mysql|table|database|column|migration|ddl)\b"
ROUTES = {"discrepancy": ("discrepancies", "docs", "repos"), "incident": ("playbooks", "docs", "repos"), "general": ("repos", "docs")}

BLOCK_QUERIES = 2048
SLICE = 1 << 21  # scores computed at once
DIGITS = 6
DIMENSIONS = 64


# --- routing ---------------------------------------------------------------------------------------------------------

def intent(question: Column, explicit: Column | None = None, strict_stems: bool = True) -> Column:
    found = F.when(question.rlike(DISCREPANCY if strict_stems else DISCREPANCY_STEMS), "discrepancy").otherwise("general")
    return found if explicit is None else F.when((F.coalesce(explicit, F.lit("")) != "") & (explicit != "auto"), explicit).otherwise(found)


def routed(intent_: Column, question: Column) -> Column:
    """array<string>: collections in search order."""
    lit = lambda names: F.array(*map(F.lit, names))
    general = F.when(question.rlike(DATABASE), lit((*ROUTES["general"], "sql"))).otherwise(lit(ROUTES["general"]))
    return F.when(intent_ == "discrepancy", lit(ROUTES["discrepancy"])).when(intent_ == "incident", lit(ROUTES["incident"])).otherwise(general)


def per_collection(k: int, n: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(F.lit(k) / F.greatest(n, F.lit(1))).cast("int") + 1)


def boost(kind: Column) -> Column:
    return F.when(kind.isin("readme", "doc"), DOC_BOOST).when(kind == "discrepancy", FINDING_BOOST).otherwise(1.0)


# --- top-k over blocks of queries ------------------------------------------------------------------------------------

def _best(found: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best rows a task has seen for each of its queries: least value first, smaller ids first among equals."""

    def __init__(self, queries: int, k: int):
        self.n, self.k, self.held = queries, k, 0
        self.worst = np.full(queries, np.inf)  # what a further row must not exceed
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """values: queries x rows, infinite where a row is none of a query's."""
        q, d = np.nonzero((values <= self.worst[:, None]) & (values < np.inf))
        if len(q):
            self.parts.append((q, values[q, d], ids[d]))
            self.held += len(q)
            if self.held > max(SLICE >> 3, 4 * self.n * self.k):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, value, id) of the best so far, in order."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, v, i = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((np.unique(i, return_inverse=True)[1], v, q))
        q, v, i = q[order], v[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        q, v, i, place = q[keep], v[keep], i[keep], place[keep]
        self.worst[q[place == self.k - 1]] = v[place == self.k - 1]
        self.parts, self.held = [(q, v, i)], len(q)
        return q, v, i


def _codes(scopes: list, known: dict) -> np.ndarray:
    """Numbers of scopes: -2 for none, -1 for one that no query has."""
    return np.array([-2 if x is None else known.get(x, -1) for x in scopes], np.int64)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vec_col: str = "embedding", skip_self: bool = True,
                query_id: str | None = None, group: str | None = None, scope: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest by cosine distance, rounded to DIGITS, smaller ids first among equals.

    group: a column of the vectors; the k nearest are listed for each of its values, which is a further column of the
    result. scope: a column of both tables; a row is seen by the queries of its own scope and by those without one, a
    row without a scope by all. Null, empty and zero vectors, and those of another length than the query, have no
    distance and are not listed.
    """
    query_id = query_id or id_col
    kinds, out_group = (dict(queries.dtypes)[query_id], dict(vectors.dtypes)[id_col]), [] if group is None else [group]
    none = F.lit(None).cast("string")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (none if group is None else F.col(group)).alias("g"), (none if scope is None else F.col(scope)).alias("s")).where(F.size("v") > 0)
    asked = queries.select(F.col(query_id).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (none if scope is None else F.col(scope)).alias("s")).where(F.size("v") > 0)
    schema = f"query_id {kinds[0]}, id {kinds[1]}, g string, distance double"

    def blocks() -> Iterator[tuple]:
        part: list = []
        for r in asked.toLocalIterator():
            part.append(r)
            if len(part) == BLOCK_QUERIES:
                yield from _by_length(part)
                part = []
        yield from _by_length(part)

    def apply(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, scopes = sent.value
            known = {x: i for i, x in enumerate(dict.fromkeys(s for s in scopes if s is not None))}
            mine = _codes(scopes, known)[:, None]
            best: dict = {}
            for b in batches:
                col = b.column(1)
                sizes = np.diff(col.offsets.to_numpy())
                ok = np.flatnonzero(sizes == q.shape[1])
                if not len(ok):
                    continue
                v = np.array(col.take(pa.array(ok)).flatten()).reshape(len(ok), -1)
                keep = np.isfinite(v).all(1) & ((v * v).sum(1) > 0)
                v, at = v[keep], ok[keep]
                v = v / np.sqrt((v * v).sum(1, keepdims=True))
                who, groups = np.array(b.column(0).take(pa.array(at)).to_pylist()), np.array(["" if x is None else x for x in b.column(2).take(pa.array(at)).to_pylist()])
                theirs = _codes(b.column(3).take(pa.array(at)).to_pylist(), known)
                for g in np.unique(groups):
                    of = np.flatnonzero(groups == g)
                    for a in range(0, len(of), max(1, SLICE // len(ids))):
                        x = of[a:a + max(1, SLICE // len(ids))]
                        d = np.round(1 - q @ v[x].T, DIGITS)
                        if scope is not None:
                            d[(mine != -2) & (theirs[x] != -2) & (mine != theirs[x])] = np.inf
                        if skip_self:
                            d[ids[:, None] == who[x]] = np.inf
                        best.setdefault(str(g), _Best(len(ids), k)).add(d, who[x])
            for g, found in best.items():
                i, d, who = found.cut()
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i].tolist()), pa.array(who.tolist()), pa.array([g] * len(i)), pa.array(d)], names=["query_id", "id", "g", "distance"])

        return rows.mapInArrow(run, schema)

    out = each_block(vectors.sparkSession, blocks(), apply)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    out = out.drop("g") if group is None else out.withColumnRenamed("g", group)
    return _best(out, ["query_id", *out_group], [F.col("distance"), F.col("id")], k)


def _by_length(part: list) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Ids, vectors of unit length and scopes of queries, those of equal dimension together."""
    groups: dict[int, list] = {}
    for i, v, s in part:
        if all(x is not None for x in v) and any(v):
            groups.setdefault(len(v), []).append((i, v, s))
    for g in groups.values():
        q = np.array([v for _, v, _ in g])
        yield np.array([i for i, _, _ in g]), q / np.sqrt((q * q).sum(1, keepdims=True)), [s for _, _, s in g]


def hash_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """array<double>: counts of a text's words by the hash of the word; stands in where no embedding is stored."""
    at = F.transform(T.tokens(text), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dimensions))

    @F.pandas_udf("array<double>")
    def counts(buckets: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.bincount(np.asarray(b, np.int64), minlength=dimensions).astype(float) for b in buckets])

    return counts(at)


def corpus_stats(corpus: DataFrame, group: str = "collection", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(by group: n_docs, avgdl, mean_idf; by group and term: df, idf), from partial sums over the whole corpus."""
    words = corpus.select(group, T.tokens(text).alias("w"))
    docs = words.groupBy(group).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w")).alias("avgdl"))
    df = words.select(group, F.explode(F.array_distinct("w")).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = df.join(F.broadcast(docs.select(group, "n_docs")), group).withColumn("idf", raw)  # one row a collection
    mean = idf.groupBy(group).agg(F.avg("idf").alias("mean_idf"))
    floored = idf.join(F.broadcast(mean), group).withColumn("idf", F.when(F.col("idf") < 0, F.lit(BM25_EPSILON) * F.col("mean_idf")).otherwise(F.col("idf")))
    return docs.join(mean, group, "left"), floored.select(group, "term", "df", "idf")


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = LEXICAL_K, id_col: str = "id", query_id: str = "item_id", query_text: str = "query", group: str = "collection", text: str = "text") -> DataFrame:
    """(query_id, collection, id, score, rank): the k best by Okapi BM25 within each collection, scores above 0 only.

    Statistics cover the whole corpus; of its terms only those of the queries are kept. A block's queries are sent as
    postings, a list of queries and weights a term, so their size is that of the queries themselves.
    """
    spark = corpus.sparkSession
    kinds = dict(corpus.dtypes)[id_col], dict(queries.dtypes)[query_id]
    schema = f"{group} string, query_id {kinds[1]}, id {kinds[0]}, score double"
    docs, terms = corpus_stats(corpus, group, text)
    asked = queries.select(F.col(query_id).alias("q"), T.tokens(F.coalesce(query_text, F.lit(""))).alias("w")).where(F.size("w") > 0)
    wanted = asked.select(F.explode("w").alias("term")).distinct()
    stats = cut_lineage(terms.join(wanted, "term", "left_semi").join(docs.select(group, "avgdl"), group).select(group, "term", "idf", "avgdl"))
    rows = corpus.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(text).alias("t")).where(F.col("t") != "")

    def blocks() -> Iterator[tuple]:
        part: list = []
        for r in asked.toLocalIterator():
            part.append(r)
            if len(part) == BLOCK_QUERIES:
                yield postings(part)
                part = []
        if part:
            yield postings(part)

    def postings(part: list) -> tuple:
        counts = [Counter(r.w) for r in part]
        words = spark.createDataFrame([(t,) for t in {t for c in counts for t in c}], "term string")
        weight: dict[tuple[str, str], float] = {}
        avgdl: dict[str, float] = {}
        for r in stats.join(F.broadcast(words), "term", "left_semi").collect():  # a block's words only
            weight[r[group], r.term], avgdl[r[group]] = r.idf, r.avgdl
        lists: dict[str, dict[str, tuple[np.ndarray, np.ndarray]]] = {}
        holders: dict[str, list[int]] = {}
        for j, c in enumerate(counts):
            for t in c:
                holders.setdefault(t, []).append(j)
        for (g, t), w in weight.items():
            q = holders[t]
            lists.setdefault(g, {})[t] = np.array(q), np.array([counts[j][t] * w for j in q])
        return [r.q for r in part], lists, avgdl

    def apply(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, lists, avgdl = sent.value
            best: dict[str, _Best] = {}
            held: dict[str, list] = {}

            def score(g: str) -> None:
                """Scores a slice of documents, queries x documents, and keeps the best."""
                part = held.pop(g, [])
                if part:
                    at = np.concatenate([q + d * len(ids) for d, (_, qs, _) in enumerate(part) for q in qs])
                    s = np.bincount(at, np.concatenate([w for _, _, ws in part for w in ws]), len(ids) * len(part)).reshape(len(part), -1).T
                    s = np.round(s, DIGITS)
                    best.setdefault(g, _Best(len(ids), k)).add(np.where(s > 0, -s, np.inf), np.array([i for i, _, _ in part]))

            for b in batches:
                for g, i, t in zip(*(c.to_pylist() for c in b.columns)):
                    mine = lists.get(g)
                    if not mine:
                        continue
                    w = t.lower().split()
                    c = Counter(x for x in w if x in mine)
                    if not c:
                        continue
                    norm = BM25_K1 * (1 - BM25_B + BM25_B * len(w) / avgdl[g])
                    part = held.setdefault(g, [])
                    part.append((i, [mine[x][0] for x in c], [mine[x][1] * (n * (BM25_K1 + 1) / (n + norm)) for x, n in c.items()]))
                    if len(part) * len(ids) >= SLICE:
                        score(g)
            for g in list(held):
                score(g)
            for g, found in best.items():
                q, s, i = found.cut()
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(q)), pa.array([ids[x] for x in q]), pa.array(i.tolist()), pa.array(-s)], names=[group, "query_id", "id", "score"])

        return rows.mapInArrow(run, schema)

    out = each_block(spark, blocks(), apply)
    if out is None:
        out = spark.createDataFrame([], schema)
    return _best(out, ["query_id", group], [F.desc("score"), F.col("id")], k)


# --- fusion and context ----------------------------------------------------------------------------------------------

def rrf(vector: DataFrame, lexical: DataFrame, keys: list[str], weight: float = VECTOR_WEIGHT, k: int = RRF_K, query_id: str = "query_id") -> DataFrame:
    """(query, keys, rrf_score): weighted reciprocal ranks of two lists with a 0-based `rank0`, summed by key."""
    w = min(1.0, max(0.0, weight))
    both = vector.select(query_id, *keys, (F.lit(w) / (F.col("rank0") + k + 1)).alias("s")).unionByName(lexical.select(query_id, *keys, (F.lit(1 - w) / (F.col("rank0") + k + 1)).alias("s")))
    return both.groupBy(query_id, *keys).agg(F.sum("s").alias("rrf_score"))


HYBRID_SETTING = "spark.millrace.hybrid"


def use_hybrid(spark: SparkSession, explicit: bool | None = None) -> bool:
    """Whether words are searched beside vectors: as asked for, else by the session's setting, else not."""
    return explicit if explicit is not None else str(spark.conf.get(HYBRID_SETTING, "false")).lower() in ("1", "true", "yes")


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, hybrid: bool | None = None, forced: int = 2, vec_col: str = "vec") -> DataFrame:
    """(query_id, place, collection, id, distance, rrf_score): the k best pieces of each query over its routed collections.

    corpus: collection, id, repo, kind, text and a vector; queries: query_id, query, route, repo and a vector. The
    vector lists are concatenated in routing order, nearest first within a collection, and only then boosted by kind; a
    query's repository bounds code and documents, the SQL tree is a repository of its own. With `hybrid`, the lexical
    lists are fused with them by weighted reciprocal ranks; a query no word of which is found keeps its vector list,
    by distance. The nearest documents of the query's repository come first if they are not among what was found.
    """
    own = F.when(F.col("collection").isin("repos", "docs"), F.col("repo"))
    seen = corpus.where("collection <> 'sql' OR repo = 'SQL-SCRIPTS'").withColumn("scope", own)
    asked = queries.withColumn("scope", F.nullif("repo", F.lit("")))
    near = vector_topk(seen, asked, max(2, k + 1, forced), "id", vec_col, False, "query_id", "collection", "scope")
    route = queries.select("query_id", F.posexplode("route").alias("col_pos", "collection"), per_collection(k, F.size("route")).alias("fan_out"))
    kinds = corpus.select("id", "kind")
    far = (near.join(route, ["query_id", "collection"]).where((F.col("rank") <= F.col("fan_out")) | (F.col("collection") == "docs") & (F.col("rank") <= forced))
           .join(kinds, "id").withColumn("distance", F.round(F.col("distance") / boost(F.col("kind")), DIGITS)))
    by_query = W.partitionBy("query_id")
    listed = far.where("rank <= fan_out").withColumn("rank0", F.row_number().over(by_query.orderBy("col_pos", "rank")) - 1)
    keys = ["collection", "id"]
    both = listed.select("query_id", *keys, "distance", F.col("rank0").alias("ord"), (F.lit(VECTOR_WEIGHT) / (F.col("rank0") + RRF_K + 1)).alias("s"), F.lit(0).alias("lexical"))
    if use_hybrid(corpus.sparkSession, hybrid):
        words = bm25_topk(corpus, queries, LEXICAL_K, query_id="query_id").join(route, ["query_id", "collection"]).withColumn("rank0", F.row_number().over(by_query.orderBy("col_pos", "rank")) - 1)
        both = both.unionByName(words.select("query_id", *keys, F.round(1.0 / (1.0 + F.col("score")), DIGITS).alias("distance"), (F.col("rank0") + (1 << 20)).alias("ord"),
                                             (F.lit(1 - VECTOR_WEIGHT) / (F.col("rank0") + RRF_K + 1)).alias("s"), F.lit(1).alias("lexical")))
    one = both.groupBy("query_id", *keys).agg(F.round(F.sum("s"), 9).alias("rrf_score"), F.min("ord").alias("ord"), F.min_by("distance", "ord").alias("distance"), F.max("lexical").alias("lexical"))
    fused = F.max("lexical").over(by_query) == 1
    placed = one.withColumn("fused", fused).withColumn("at", F.row_number().over(by_query.orderBy(F.when(F.col("fused"), -F.col("rrf_score")).otherwise(F.col("distance")), "ord")))
    first = (far.where((F.col("collection") == "docs") & (F.col("rank") <= forced)).join(asked.where("scope IS NOT NULL").select("query_id"), "query_id")
             .join(one.select("query_id", *keys), ["query_id", *keys], "left_anti").select("query_id", *keys, "distance", F.lit(None).cast("double").alias("rrf_score"), (-F.col("rank")).alias("at")))
    every = placed.select("query_id", *keys, "distance", F.when(F.col("fused"), F.col("rrf_score")).alias("rrf_score"), "at").unionByName(first)
    return _best(every, ["query_id"], [F.col("at")], k).select("query_id", F.col("rank").alias("place"), *keys, "distance", "rrf_score")


def filter_context(hits: DataFrame, max_chunks: int = MAX_CHUNKS, max_distance: float = MAX_DISTANCE, strong: float = STRONG_DISTANCE, early_stop: int = EARLY_STOP, per_path: int = PER_PATH) -> DataFrame:
    """Hits fit for a prompt, with their `rank`: near enough (or the nearest one), few a path, few enough if strong.

    Needs query_id, pos, hit_id, repo, path, distance. A missing distance counts as 1. Once early_stop strong hits are
    chosen no more are taken; as strong hits come first, that is a limit known from their number.
    """
    d = F.coalesce("distance", F.lit(1.0))
    by_query = W.partitionBy("query_id").orderBy("d", "pos", "hit_id")
    gated = (hits.withColumn("d", d).withColumn("path_key", T.path_key(F.col("repo"), F.col("path"))).withColumn("first", F.row_number().over(by_query))
             .withColumn("near", F.sum((F.col("d") <= max_distance).cast("int")).over(W.partitionBy("query_id"))).where((F.col("d") <= max_distance) | (F.col("near") == 0) & (F.col("first") == 1)))
    capped = gated.withColumn("of_path", F.row_number().over(W.partitionBy("query_id", "path_key").orderBy("d", "pos", "hit_id"))).where(F.col("of_path") <= per_path)
    n_strong = F.sum((F.col("d") <= strong).cast("int")).over(W.partitionBy("query_id"))
    most = F.greatest(F.lit(1), F.least(F.lit(max_chunks), F.when(n_strong >= early_stop, early_stop).otherwise(max_chunks)))
    return capped.withColumn("most", most).withColumn("rank", F.row_number().over(by_query)).where("rank <= most").drop("first", "near", "of_path", "most")


PHRASINGS = 2


def phrasings(requests: DataFrame) -> DataFrame:
    """Each request (request_id, request, repo, incident) as two queries: its own words, and a question for the place to start.

    Both are searched with the request's intent: an incident's, a drift's if it speaks of one, else a general one.
    """
    r = F.coalesce("request", F.lit(""))
    found = intent(r)
    kind = F.when(F.coalesce("incident", F.lit("")) != "", "incident").when((found == "general") & T.speaks_of_drift(r), "discrepancy").otherwise(found)
    both = F.array(F.substring(r, 1, 500), F.concat(F.lit("entry point related to: "), F.substring(r, 1, 200)))
    q = requests.select("request_id", "repo", kind.alias("kind"), F.posexplode(both).alias("phrase", "query"))
    return q.withColumn("query_id", F.col("request_id") * PHRASINGS + F.col("phrase")).withColumn("route", routed(F.col("kind"), F.col("query")))


def fix_context(corpus: DataFrame, requests: DataFrame, embed: Callable[[Column], Column], k: int = 4) -> DataFrame:
    """(request_id, context, blocks): what both phrasings of a request find, as one context.

    corpus: as for `retrieve`, with path and chunk.
    """
    q = phrasings(requests)
    got = retrieve(corpus, q.withColumn("vec", embed(F.col("query"))), k, False).withColumn("request_id", F.floor(F.col("query_id") / PHRASINGS)).withColumn("pos", F.col("query_id") % PHRASINGS * k + F.col("place"))
    hits = got.select(F.col("request_id").alias("query_id"), "pos", F.col("id").alias("hit_id"), "distance").join(corpus.select(F.col("id").alias("hit_id"), "collection", "repo", "path", "chunk", "text"), "hit_id")
    return context_block(filter_context(hits)).withColumnRenamed("query_id", "request_id")


def snippet_budget(distance: Column, most: int = MAX_CHARS, strong: float = STRONG_DISTANCE, weak: float = MAX_DISTANCE) -> Column:
    t = (distance - strong) / max(weak - strong, 1e-6)
    return F.when(distance <= strong, most).when(distance >= weak, max(120, most // 4)).otherwise(F.greatest(F.lit(120), (F.lit(float(most)) * (1.0 - 0.75 * t)).cast("int")))


def context_block(filtered: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """(query_id, context, blocks): the chosen snippets as one text, equal blocks once."""
    block = F.concat(F.lit("### ["), F.col("collection"), F.lit("] "), F.col("path_key"), F.lit(" (chunk "), F.col("chunk").cast("string"), F.lit(")\n"),
                     F.substring(F.coalesce("text", F.lit("")), F.lit(1), snippet_budget(F.col("d"), most)))
    blocks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x.b))  # at most MAX_CHUNKS a query
    return filtered.groupBy("query_id").agg(blocks.alias("b")).select("query_id", F.array_join("b", "\n\n").alias("context"), F.size("b").alias("blocks"))


def matches(expect: Column, repo: Column, path: Column, text: Column, path_only: Column) -> Column:
    needle = F.lower(expect)
    on_path = F.lower(F.concat(F.coalesce(repo, F.lit("")), F.lit("/"), path)).contains(needle)
    return F.coalesce((expect != "") & (on_path | ~F.coalesce(path_only, F.lit(False)) & F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 200)).contains(needle)), F.lit(False))
