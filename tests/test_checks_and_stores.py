import pytest
from pyspark.sql import functions as F

from millrace.operators import checks as K, corpus as C, edits as E
from millrace.sources import sqltext, tree
from millrace.sources.store import Store, index


def test_guard(spark):
    spark.range(3).createOrReplaceTempView("t3")
    for sql in ("SELECT * FROM t3", "-- x\nWITH a AS (SELECT 1) SELECT * FROM a", "SHOW TABLES", "DESCRIBE t3"):
        assert not sqltext.writes(spark, sql), sql
    for sql in ("DELETE FROM t3", "/* c */ INSERT INTO t3 VALUES (1)", "DROP TABLE x", "CREATE TABLE x AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t3 SELECT * FROM a", "TRUNCATE TABLE t3", "SET a = b", "CREATE TEMP VIEW v AS SELECT 1"):
        assert sqltext.writes(spark, sql), sql
    assert not sqltext.writes(spark, "SET a = b", allow_session=True)
    with pytest.raises(PermissionError):
        sqltext.run_read_only(spark, "DROP TABLE x")
    assert sqltext.run_read_only(spark, "SELECT count(*) AS n FROM t3;").first().n == 3


def test_splitter():
    assert sqltext.split("/* a; */ SELECT 1; -- b;\nSELECT ';', \"x;y\" ; \n\n") == ["SELECT 1", "SELECT ';', \"x;y\""]
    assert sqltext.split("") == [] and sqltext.split("SELECT 1 /* open") == ["SELECT 1"]


def test_metrics(spark):
    def m(sql, mode):
        r = K.measure(spark.sql(sql), mode).first()
        return r.row_count, r.metric_value
    assert m("SELECT 7 AS x", "rows") == (1, 7.0) and m("SELECT 'boom' AS x", "rows") == (1, 1.0) and m("SELECT 'boom' AS x", "compat") == (1, 0.0)
    assert m("SELECT 'a' AS id, CAST(3.5 AS DECIMAL(9,2)) AS total", "compat") == (1, 3.5) and m("SELECT 'a 1,200' AS id, 9 AS z", "compat") == (1, 1200.0)
    assert m("SELECT * FROM range(4)", "rows") == (4, 4.0) and m("SELECT * FROM range(0)", "compat") == (0, 0.0)
    assert K.measure(spark.range(9)).first().sample_rows == [f'{{"id":{i}}}' for i in range(5)]


def test_verdicts(spark):
    s = "a string, m double, n long, t double, p double, b double"
    rows = [("max_rows", 0.0, 0, None, None, None, True), ("max_rows", 1.0, 1, None, None, None, False), ("max_rows", 1.0, 9, 8.0, None, None, False), ("min_rows", 0.0, 2, 3.0, None, None, False), ("exact_rows", 0.0, 3, 3.0, None, None, True),
            ("min_scalar", 0.0, 1, 0.0, None, None, True), ("min_scalar", 0.5, 1, None, None, None, False), ("baseline_delta_pct", 125.0, 1, None, None, 100.0, True), ("baseline_delta_pct", 126.0, 1, None, None, 100.0, False),
            ("baseline_delta_pct", 5.0, 1, None, None, 0.0, True), ("baseline_delta_pct", 5.0, 1, None, 0.0, None, True), ("other", 1.0, 1, None, None, None, True)]
    v = K.verdict(*[F.col(c) for c in ("a", "m", "n", "t", "p", "b")])
    assert [r[0] for r in spark.createDataFrame([r[:6] for r in rows], s).select(v.passed).collect()] == [r[6] for r in rows]


def test_run_and_baselines(spark):
    spark.range(10).createOrReplaceTempView("t10")
    checks = [K.Check("bad", "SELECT nope FROM t10"), K.Check("delta", "SELECT count(*) AS cnt FROM t10", "baseline_delta_pct"), K.Check("rows", "SELECT id FROM t10")]
    base = spark.createDataFrame([("delta", 9.0, None), ("kept", 1.0, None)], "check_id string, value double, recorded_at timestamp")
    r = K.run(spark, checks, base)
    got = {x.check_id: x for x in r.collect()}
    assert not got["bad"].ok and not got["bad"].passed and got["delta"].passed and not got["rows"].passed and len(got["rows"].sample_rows) == 5
    assert {x.check_id: x.value for x in K.new_baselines(r, base, checks, F.current_timestamp()).collect()} == {"delta": 10.0, "kept": 1.0}
    assert K.summary(r).first()[:] == (1, 2, 3)


def test_rolling_baseline(spark):
    vals = [100, 120, 200, 130, 0, 5, 6]
    h = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(vals)], "check_id string, run int, value double").repartition(3)
    base, want = None, []
    for v in vals:
        ok = not base or abs(v - base) / abs(base) * 100 <= 25
        want.append((base, ok))
        base = float(v) if ok else base
    assert [(r.baseline, r.passed) for r in K.rolling_baseline(h).orderBy("run").collect()] == want
    assert [r.run for r in K.retain(h, most=2).orderBy("run").collect()] == [5, 6]
    assert spark.range(1).select(K.fill(F.lit("{a} of {b}"), a=F.lit(1.5), b=F.lit(None))).first()[0] == "1.5 of None"


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def test_incremental_index(spark, tmp_path):
    root, chunks, manifest = tmp_path / "repos", Store(spark, str(tmp_path / "chunks"), ("collection", "path"), 4), Store(spark, str(tmp_path / "manifest"), ("collection", "rel_path"), 4)
    write(root, {"A/README.md": "hello", "A/x.py": "print(1)\n" * 400, "A/node_modules/y.js": "no", "A/.env": "S=1", "B/z.sh": "echo \xff".encode("latin-1"), "SQL-SCRIPTS/q.sql": "select 1;\nselect 2;\n", "A/img.png": "x"})
    files = lambda: tree.collections(tree.scan(spark, str(root)))
    assert index(spark, files(), chunks, manifest) == (5, 0)
    paths = {(r.collection, r.path) for r in chunks.read().collect()}
    assert paths == {("repos", "A/README.md"), ("docs", "A/README.md"), ("repos", "A/x.py"), ("repos", "B/z.sh"), ("sql", "SQL-SCRIPTS/q.sql")}
    assert chunks.read().where("path = 'A/x.py'").count() == 4
    assert index(spark, files(), chunks, manifest) == (0, 0)
    write(root, {"A/x.py": "print(2)"})
    (root / "B/z.sh").unlink()
    assert index(spark, files().where("rel_path LIKE 'A/%'"), chunks, manifest, repo="A") == (1, 0)
    assert chunks.read().where("path = 'A/x.py'").count() == 1 and chunks.read().where("path = 'B/z.sh'").count() == 1
    assert index(spark, files(), chunks, manifest) == (0, 1) and chunks.read().where("path = 'B/z.sh'").count() == 0
    ids = [r.id for r in chunks.read().collect()]
    assert len(ids) == len(set(ids))


def test_changed_and_removed(spark):
    s = "collection string, rel_path string, mtime long, size long, hash string"
    now = spark.createDataFrame([("c", "same", None, 1, "h"), ("c", "touched", 2, 1, "h"), ("c", "new", 1, 1, None)], s)
    old = spark.createDataFrame([("c", "same", None, 1, "h"), ("c", "same", 9, 9, "x"), ("c", "touched", 1, 1, "h"), ("c", "gone", 1, 1, "h")], s)
    assert {r.rel_path for r in C.changed(now, old).collect()} == {"touched", "new"}
    assert [r.rel_path for r in C.removed(now, old).collect()] == ["gone"]


def test_edits(spark):
    f = spark.createDataFrame([("a", "alpha\nbeta\ngamma"), ("x", "x\nx"), ("d", "bye")], "path string, content string")
    e = spark.createDataFrame([("a", 1, "replace", "beta", "BETA", None), ("a", 2, "replace", "BETA", "b", None), ("x", 1, "replace", "x", "y", None), ("new", 1, "create", None, None, "hi"), ("d", 1, "delete", None, None, None),
                               ("../up", 1, "create", None, None, "no"), ("none", 1, "replace", "q", "r", None), ("a", 3, "replace", "alpha", "A", None)], "path string, ord int, type string, old_str string, new_str string, content string")
    got = {r.path: (r.content, r.deleted, r.error) for r in E.apply_edits(f, e).collect()}
    assert got == {"a": ("A\nb\ngamma", False, None), "x": ("x\nx", False, "matched 2 times"), "new": ("hi", False, None), "d": (None, True, None), "../up": (None, False, "path escape"), "none": (None, False, "file not found")}
    once = {r.path: (r.content, r.error) for r in E.replace_once(f, spark.createDataFrame([("a", "beta", "B"), ("x", "x", "y"), ("d", "zz", "")], "path string, old_str string, new_str string")).collect()}
    assert once == {"a": ("alpha\nB\ngamma", None), "x": ("x\nx", "matched 2 times"), "d": ("bye", "not found")}


def test_drift_and_audit(spark):
    readme = spark.createDataFrame([("R", "see `gone.py`, `here.py` and `d/deep.py`; set APP_TOKEN_X and README and MY_KEY")], "repo string, text string")
    files = spark.createDataFrame([("R", "here.py")], "repo string, rel_path string")
    assert {r.ref for r in C.missing_refs(readme, files).collect()} == {"gone.py"} and {r.ref for r in C.missing_refs(readme, files, wide=True).collect()} == {"gone.py", "d/deep.py"}
    ex = spark.createDataFrame([("R", "MY_KEY=1")], "repo string, text string")
    assert [r.ref for r in C.env_not_in_example(readme, ex).collect()] == ["APP_TOKEN_X"]
    f = spark.createDataFrame([("a.py", "ok\ncall +15551239999\n/Users/YOU/x\n/Users/bob"), ("b.bin", "/Users/bob"), ("c.txt", "")], "path string, content string")
    assert {(r.path, r.line, r.rule) for r in E.audit(f).collect()} == {("a.py", 2, "phone_number"), ("a.py", 4, "home_path")}


def test_anomalies(spark):
    r = spark.createDataFrame([("a", False, 3.0, "count 3.0 > max 0.0", None, "w"), ("b", True, 1.0, "x", None, "w"), ("c", False, None, None, "boom", "w")], "check_id string, passed boolean, metric_value double, reason string, error string, severity string")
    known = spark.range(1).select(K.anomaly_fingerprint(F.lit("a"), F.lit(3.0), F.lit("count 3.0 > max 0.0")).alias("fingerprint"), F.lit("ANOMALY_OPEN").alias("state"), F.lit(4).alias("seen_count"))
    assert {x.check_id: (x.seen_count, x.new) for x in K.anomalies(r, known).collect()} == {"a": (5, False), "c": (1, True)}


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_store(spark, tmp_path, keys):
    s = Store(spark, str(tmp_path / "t"), keys, 8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    got = lambda: sorted(map(tuple, s.read().collect()))
    assert s.read("k long, v string").count() == 0 and s.current() is None
    s.replace(frame([(i, "a") for i in range(40)]))
    before = s.current()
    s.upsert(frame([(3, "b"), (99, "b")]), ("k",))
    assert got() == sorted([(i, "b" if i == 3 else "a") for i in range(40)] + [(99, "b")])
    if keys:
        kept = sum(s.current()[b] == f for b, f in before.items())
        assert kept >= len(before) - 2  # only the buckets that were touched are written again
    held = s.read()
    s.append(frame([(3, "c")]))
    assert len(got()) == 42 and held.count() == 41
    s.change(frame([(3, "")]).select("k"), lambda stored: stored.where("k <> 3"))
    assert (3, "c") not in got() and len(got()) == 40
    s.change(frame([(i, "") for i in range(100)]).select("k"), lambda stored: stored.where("k < 0"))
    assert s.read("k long, v string").count() == 0
    s.append(frame([(1, "z")]))
    assert got() == [(1, "z")]


def test_a_dead_run_leaves_the_current_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ("k",), 4)
    s.replace(spark.range(20).select(F.col("id").alias("k")))
    boom = F.udf(lambda k: 1 // (k - 7), "long")
    with pytest.raises(Exception):
        s.change(spark.range(20).select(F.col("id").alias("k")), lambda stored: stored.select(boom("k").alias("k")))
    assert s.read().count() == 20
