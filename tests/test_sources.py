import json
import os
import subprocess
import sys
import uuid
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from millrace.operators.incidents import RAW
from millrace.plans.streams import run_available
from millrace.sources import events, jdbc, sqltext
from millrace.streaming import lifecycle, windows


def test_events_from_files_and_texts(spark, tmp_path):
    rows = [{"ts": f"2025-01-0{i}T00:00:00Z", "kind": "timeout", "tool": "t", "argv": ["./a"], "extra": 1} for i in (1, 3, 2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    e = events.read_json(spark, str(tmp_path / "in"))
    assert e.schema == spark.createDataFrame([], RAW).schema and [r.ts[:10] for r in events.latest(e.where("ts IS NOT NULL"), 2).collect()] == ["2025-01-03", "2025-01-02"]
    assert run_available(events.stream_json(spark, str(tmp_path / "in")).select("ts", "tool"), "append").where("ts IS NOT NULL").count() == 3
    texts = spark.createDataFrame([("say ```json\n{\"a\": 1}\n``` end",), ("x {\"a\": 2} y",), ("none",)], "t string")
    assert [r[0] for r in texts.select(events.fenced_json(F.col("t"), "a int").a).collect()] == [1, 2, None]
    p = spark.createDataFrame([(7, '{"tool": "x", "argv": ["b"]}', "err"), (8, None, None)], "delivery_id long, mac_payload string, raw_stderr_tail string")
    assert [(r.delivery_id, r.tool, r.argv, r.stderr) for r in events.from_payload(p).collect()] == [(7, "x", ["b"], "err"), (8, None, None, None)]
    events.to_tsv(texts, str(tmp_path / "tsv")), events.to_json(texts, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_statements_of_a_file(spark, tmp_path):
    (tmp_path / "q.sql").write_text("/* head; */\nSELECT 1 AS a; -- one\nSELECT ';' AS b;\n")
    assert [d.first()[0] for d in sqltext.run_file(spark, str(tmp_path / "q.sql"))] == [1, ";"]
    assert sqltext.run_file(spark, str(tmp_path / "q.sql"), 1)[0].first()[0] == ";"
    spark.range(2).createOrReplaceTempView("shown")
    assert "shown: id bigint" in sqltext.schema_text(spark, wanted=["shown"])


def test_database_source(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    spark.range(100).withColumn("v", F.col("id") * 2).write.format("jdbc").option("url", url).option("dbtable", "t").save()
    assert jdbc.query(spark, url, 'SELECT * FROM t WHERE "id" < 10').count() == 10
    t = jdbc.table(spark, url, "t", "id", 0, 100, 4)
    assert t.rdd.getNumPartitions() == 4 and t.where("id >= 90").agg(F.sum("v")).first()[0] == sum(2 * i for i in range(90, 100))


CUSTOMERS = [(1, 'a "q", b\n c\r\n"', 0.1 + 0.2), (2, "", 1e-17), (3, None, 2.5), (4, "  lead, trail ", 1e300), (5, '","', 5.0), (6, "\\", 6.0), (7, "é😀" * 50_000, 7.0), (8, "none", 0.0), (9, "less", -1.0), (10, "null", None), (None, "no key", 8.0)]
ELSEWHERE = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
import test_sources
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}/shared folder's").getOrCreate()
spark.createDataFrame(test_sources.CUSTOMERS, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{sys.argv[1]}/customer.parquet")
t = entry.queries()["source_jdbc"](spark, sys.argv[1])
assert t.rdd.getNumPartitions() == 4 and "GreaterThan(c_acctbal,0.0)" in t._jdf.queryExecution().toString().split("PushedFilters")[1]
assert {tuple(r) for r in t.collect()} == {r for r in test_sources.CUSTOMERS if (r[2] or 0) > 0} and t.count() == 8
spark.stop()
"""


def test_database_read_by_executors_of_their_own(tmp_path):
    (tmp_path / "home").mkdir()
    for p in Path(pyspark.__path__[0]).iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    tests = Path(__file__).resolve().parent
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": f"{tests.parent}:{tests}:{os.environ.get('PYTHONPATH', '')}"}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    run = subprocess.run([sys.executable, "-c", ELSEWHERE, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


def test_outbox_is_idempotent(spark, tmp_path):
    b = spark.createDataFrame([("f", 1, 1, "new", True), ("f", 2, 2, "duplicate", False)], lifecycle.OUT)
    write = lifecycle.outbox(str(tmp_path / "out"))
    write(b, 0), write(b, 0), write(b, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_on_a_table(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:39:00", "a"), (1, "2024-01-01 02:00:00", "b"), (2, None, "b")], "user_id int, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {(str(r.start), r.event_type, r.n) for r in windows.tumbling(e).collect()} == {("2024-01-01 00:00:00", "a", 2), ("2024-01-01 02:00:00", "b", 1)}
    assert sorted(r.n for r in windows.sessions(e).collect()) == [1, 2]
