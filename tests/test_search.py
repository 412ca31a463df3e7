import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import search as S

HITS = "query_id int, pos int, hit_id long, repo string, path string, chunk int, distance double, text string, collection string, kind string"


def hits(spark, rows):
    return spark.createDataFrame([(1, i, i, "R", p, c, d, "x" * 2000, "repos", "code") for i, (p, c, d) in enumerate(rows)], HITS)


def chosen(df, **kw):
    return [(r.path, r.distance) for r in S.filter_context(df, **kw).orderBy("rank").collect()]


def test_context_cases(spark):
    gate = hits(spark, [("a", 0, .20), ("a", 1, .22), ("b", 0, .35), ("c", 0, .50), ("d", 0, .95)])
    assert chosen(gate) == [("a", .20), ("b", .35), ("c", .50)]
    early = hits(spark, [("a", 0, .10), ("b", 0, .15), ("c", 0, .18), ("d", 0, .55), ("e", 0, .60)])
    assert chosen(early) == [("a", .10), ("b", .15), ("c", .18)]
    assert chosen(hits(spark, [("a", 0, .99)])) == [("a", .99)]
    assert chosen(hits(spark, [("a", 0, None), ("b", 0, .9)])) == [("b", .9)]


def model(rows, most, gate, strong, es, cap):
    rows = sorted(enumerate(rows), key=lambda x: (x[1][2], x[0]))
    rows = [r for _, r in rows if r[2] <= gate] or [r for _, r in rows][:1]
    out, used, n = [], Counter(), 0
    for r in rows:
        if used[r[0]] >= cap:
            continue
        out.append(r)
        used[r[0]] += 1
        n += r[2] <= strong
        if n >= es and len(out) >= es or len(out) >= most:
            break
    return [(p, d) for p, _, d in out]


def test_context_against_loop(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [(rng.choice("abcdef"), i, rng.randrange(100) / 100) for i in range(rng.randrange(1, 20))]
        kw = dict(max_chunks=rng.randrange(1, 7), max_distance=.85, strong=.4, early_stop=rng.randrange(1, 5), per_path=rng.randrange(1, 3))
        assert chosen(hits(spark, rows), **kw) == model(rows, kw["max_chunks"], .85, .4, kw["early_stop"], kw["per_path"])


def test_budget_and_block(spark):
    b = [r[0] for r in spark.createDataFrame([(.15,), (.4,), (.625,), (.80,), (.85,), (2.0,)], "d double").select(S.snippet_budget(F.col("d"))).collect()]
    assert b == [900, 900, *[max(120, int(900.0 * (1.0 - 0.75 * ((d - .4) / (.85 - .4))))) for d in (.625, .80)], 225, 225]
    c = S.context_block(S.filter_context(hits(spark, [("R/a", 0, .1), ("b", 3, .2)]))).first()
    assert c.blocks == 2 and c.context.startswith("### [repos] R/a (chunk 0)\nxxx") and "\n\n### [repos] R/b (chunk 3)\n" in c.context


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (200, 4)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in S.vector_topk(df, df.where("vec_id % 50 = 0"), 5).collect()}
    for q in (0, 50, 100, 150):
        if not v[q].any():
            continue
        d = sorted((round(1 - float(v[q] @ v[i]) / math.sqrt(float(v[q] @ v[q]) * float(v[i] @ v[i])), 6), i) for i in range(200) if i != q and v[i].any())[:5]
        assert [got[(q, k + 1)][0] for k in range(5)] == [i for _, i in d]
    assert S.vector_topk(df.limit(0), df.limit(0)).count() == 0


def okapi(docs, query, k1=1.5, b=.75, eps=.25):
    words = [d.lower().split() for d in docs]
    df = Counter(t for w in words for t in set(w))
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    raw = {t: math.log(n - c + .5) - math.log(c + .5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: eps * mean if x < 0 else x for t, x in raw.items()}
    return [sum(idf.get(t, 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / avg)) for t in query.lower().split()) for w in words]


def test_bm25_against_loop(spark):
    rng = random.Random(5)
    docs = [" ".join(rng.choice(["the", "cat", "dog", "fox", "sat", "ran", "of"]) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    c = spark.createDataFrame([(f"d{i:02d}", "g", t) for i, t in enumerate(docs)] + [("z", "h", "cat"), ("y", "h", None), ("x", "h", "")], "id string, collection string, text string").repartition(3)
    q = spark.createDataFrame([(1, "cat fox cat"), (2, "unknown"), (3, None)], "item_id int, query string")
    got = [(r.query_id, r.id, r.score) for r in S.bm25_topk(c.where("collection = 'g'"), q, 5).orderBy("query_id", "rank").collect()]
    want = sorted(((-round(s, 6), f"d{i:02d}") for i, s in enumerate(okapi(docs, "cat fox cat"))))[:5]
    assert [(q, i) for q, i, _ in got] == [(1, i) for s, i in want if s < 0]
    assert all(abs(g[2] + w[0]) < 1e-5 for g, w in zip(got, want))
    assert S.bm25_topk(c.limit(0), q).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, k string, rank0 int")
    b = spark.createDataFrame([(1, "y", 0), (1, "z", 1)], "query_id int, k string, rank0 int")
    got = {r.k: r.rrf_score for r in S.rrf(a, b, ["k"]).collect()}
    assert got["x"] == .7 / 61 and abs(got["y"] - (.7 / 62 + .3 / 61)) < 1e-15 and abs(got["z"] - .3 / 62) < 1e-12


def test_routing(spark):
    rows = [("is there a mismatch", None), ("discrepancy", None), ("which table", "auto"), ("x", "incident"), ("doesn't match", "")]
    df = spark.createDataFrame(rows, "q string, i string")
    i = S.intent(F.col("q"), F.col("i"))
    assert [r[0] for r in df.select(i).collect()] == ["discrepancy", "general", "general", "incident", "discrepancy"]
    assert df.select(S.intent(F.col("q"), F.col("i"), strict_stems=False)).collect()[1][0] == "discrepancy"
    assert [r[0] for r in df.select(S.routed(i, F.col("q"))).collect()][2:4] == [["repos", "docs", "sql"], ["playbooks", "docs", "repos"]]


def test_several_blocks_of_queries_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"d{i}", rng.choice(["repos", "docs"]), " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(80)], "id string, collection string, text string").repartition(4)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words + ["none"], k=3)) if i else None) for i in range(7)], "item_id long, query string")
    vec = spark.createDataFrame([(i, [float(rng.randrange(-3, 4)) for _ in range(4)], rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for i in range(60)], "vec_id long, embedding array<double>, scope string, kind string").repartition(3)
    run = lambda: ([tuple(r) for r in S.bm25_topk(docs, asked, 4).orderBy("query_id", "collection", "rank").collect()],
                   [tuple(r) for r in S.vector_topk(vec, vec.where("vec_id < 9"), 3, group="kind", scope="scope").orderBy("query_id", "kind", "rank").collect()])
    one = run()
    monkeypatch.setattr(S, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(S, "SLICE", 16)
    assert run() == one and len(one[0]) > 20 and len(one[1]) > 20
    rows = {r.vec_id: r for r in vec.collect()}
    for q, kind in {(r[0], r[3] if isinstance(r[3], str) else r[2]) for r in one[1]}:
        a = rows[q]
        d = sorted((round(1 - float(np.dot(a.embedding, v.embedding)) / (np.linalg.norm(a.embedding) * np.linalg.norm(v.embedding)), 6), v.vec_id) for v in rows.values()
                   if v.vec_id != q and v.kind == kind and any(v.embedding) and (a.scope is None or v.scope is None or v.scope == a.scope))[:3]
        got = S.vector_topk(vec, vec.where(F.col("vec_id") == q), 3, group="kind", scope="scope").where(F.col("kind") == kind).orderBy("rank").collect() if q == 1 else None
        assert got is None or [(r.distance, r.id) for r in got] == d


def test_hybrid_against_loop(spark):
    """The whole of retrieval for one query after another: lists concatenated in routing order, boosted, fused, documents first."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"{c}{i:02d}", c, rng.choice(["A", "B"]), "doc" if c == "docs" else "code", " ".join(rng.choices(words, k=12))) for c in ("repos", "docs") for i in range(15)] + [("s1", "sql", "SQL-SCRIPTS", "code", "w1 w2"), ("s2", "sql", "A", "code", "w1 w2")]
    corpus = spark.createDataFrame(rows, "id string, collection string, repo string, kind string, text string").withColumn("vec", S.hash_embedding("text"))
    asked = [(1, "w1 w2 w3", ["repos", "docs"], "A"), (2, "w4 w5", ["docs", "repos", "sql"], None), (3, "zz yy", ["repos"], "B"), (4, "w7", ["docs"], "")]
    queries = spark.createDataFrame(asked, "query_id long, query string, route array<string>, repo string").withColumn("vec", S.hash_embedding("query"))
    vec = {r.id: np.array(r.vec) for r in corpus.collect()}
    qvec = {r.query_id: np.array(r.vec) for r in queries.collect()}
    info = {r[0]: r for r in rows}
    words_found = {}
    for r in S.bm25_topk(corpus, queries, query_id="query_id").orderBy("rank").collect():
        words_found.setdefault((r.query_id, r.collection), []).append((r.id, r.score))
    for hybrid in (True, False):
        got = {}
        for r in S.retrieve(corpus, queries, 5, hybrid).orderBy("place").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.distance, 6)))
        for q, _, route, repo in asked:
            fan, vector, lexical = max(2, 5 // len(route) + 1), [], []
            for c in route:
                mine = [i for i, x in info.items() if x[1] == c and (c != "sql" or x[2] == "SQL-SCRIPTS") and (not repo or c == "sql" or x[2] == repo)]
                d = sorted((round(1 - float(qvec[q] @ vec[i]) / float(np.linalg.norm(qvec[q]) * np.linalg.norm(vec[i])), 6), i) for i in mine)[:fan]
                vector += [(i, round(x / (1.35 if info[i][3] == "doc" else 1.0), 6)) for x, i in d]
                lexical += [(i, round(1 / (1 + s), 6)) for i, s in words_found.get((q, c), [])] if hybrid else []
            score, first = {}, {}
            for w, part in ((0.7, vector), (1 - 0.7, lexical)):
                for n, (i, d) in enumerate(part):
                    score[i] = score.get(i, 0) + w / (60 + n + 1)
                    first.setdefault(i, d)
            want = sorted(score, key=lambda i: -round(score[i], 9)) if lexical else [i for i, _ in sorted(vector, key=lambda x: x[1])]
            assert got[q] == [(i, first[i]) for i in want[:5]], (hybrid, q)
