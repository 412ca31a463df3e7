"""Queries of failure events, their life cycle, and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import checks as K, incidents as I
from millrace.operators.delivery import canonical_hash
from millrace.sources import events as EV, sqltext
from millrace.tables import load, register

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


_HASH = r"nullif(regexp_replace(lower(regexp_replace(fingerprint, '\s+', '', 'g')), '^sha256:', ''), '')"
_LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(raw_stderr_tail, ''), '\r\n|\n|\r'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"


@query("""SELECT delivery_id, sha256(coalesce(kind, '') || '|' || coalesce(tool, '') || '|' || CASE WHEN coalesce(returncode, 0) = 0 THEN '' ELSE returncode::VARCHAR END || '|' || substr(coalesce(raw_stderr_tail, ''), 1, 500)) AS fingerprint FROM incidents""")
def event_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "incidents").select("delivery_id", I.fingerprint(F.col("kind"), F.col("tool"), F.col("returncode"), F.col("raw_stderr_tail")).alias("fingerprint"))


@query(r"""WITH e AS (SELECT delivery_id, coalesce(mac_payload->>'ts', '') AS detected_at, coalesce(nullif(mac_payload->>'kind', ''), 'nonzero_exit') AS kind, coalesce(mac_payload->>'tool', '') AS tool, coalesce(mac_payload->>'module', '') AS module,
  (mac_payload->>'returncode')::INT AS returncode, coalesce(mac_payload->>'$.argv[0]', '') AS arg, """ + _LINES + r""" AS ls, coalesce(raw_stderr_tail, '') AS err FROM incidents),
s AS (SELECT *, list_filter(ls, lambda x: NOT (starts_with(x, 'Traceback') OR starts_with(x, 'During handling'))) AS said FROM e),
m AS (SELECT module, min(repos_name) AS mapped FROM path_map GROUP BY 1)
SELECT delivery_id, detected_at, CASE WHEN starts_with(tool, 'cron_') THEN 'cron' WHEN tool = 'api_gateway' THEN tool ELSE 'mcp_tool' END AS source, CASE WHEN kind = 'timeout' THEN 'timeout' ELSE 'error' END AS severity, tool,
coalesce(nullif(mapped, ''), nullif(s.module, ''), 'UNKNOWN') AS repos_name, CASE WHEN len(ls) = 0 THEN '(no stderr)' ELSE substr(coalesce(said[-1], ls[-1]), 1, 240) END AS message, contains(err, 'Traceback') AS traced
FROM s LEFT JOIN m ON m.module = s.module""")
def event_normalize(spark: SparkSession, d: str) -> DataFrame:
    """The raw events inside the incidents' payloads, normalized anew."""
    n = I.normalize(EV.from_payload(load(spark, d, "incidents")), load(spark, d, "path_map"))
    return n.select("delivery_id", "detected_at", "source", "severity", "tool", "repos_name", "message", (F.col("stack_trace") != "").alias("traced"))


@query(r"""WITH e AS (SELECT delivery_id, coalesce(mac_payload->>'module', '') AS module, coalesce(mac_payload->>'cwd', '') AS cwd, mac_payload->>'$.argv[0]' AS a, coalesce(mac_payload->>'stderr', raw_stderr_tail, '') AS err FROM incidents),
m AS (SELECT module, min(repos_name) AS mapped FROM path_map GROUP BY 1), k AS (SELECT *, '/srv/rights/REPOS/' || module || '/' AS pre, '/REPOS/' || module || '/' AS mark, regexp_extract_all(err, 'File "([^"]+)", line (\d+)', 1) AS f FROM e)
SELECT delivery_id, coalesce(nullif(mapped, ''), nullif(k.module, ''), 'UNKNOWN') AS repos_name,
coalesce(list_filter(list_transform(f, lambda p: CASE WHEN starts_with(p, pre) THEN substr(p, length(pre) + 1) WHEN contains(p, mark) THEN substr(p, instr(p, mark) + length(mark)) END), lambda p: p IS NOT NULL)[1],
  CASE WHEN starts_with(a, './') THEN substr(a, 3) WHEN NOT contains(a, '/') THEN a END,
  CASE WHEN starts_with(cwd, pre) THEN coalesce(nullif(split_part(rtrim(substr(cwd, length(pre) + 1), '/'), '/', -1), ''), '.') END, '') AS repos_rel_path FROM k LEFT JOIN m ON m.module = k.module""")
def event_rel_paths(spark: SparkSession, d: str) -> DataFrame:
    """The failing file of each event."""
    return I.normalize(EV.from_payload(load(spark, d, "incidents")), load(spark, d, "path_map")).select("delivery_id", "repos_name", "repos_rel_path")


@query(f"""SELECT {_HASH} AS fingerprint, count(*) AS seen_count, epoch_us(min(detected_at)) AS first_detected_us, epoch_us(max(detected_at)) AS last_detected_us, arg_max(message, delivery_id) FILTER (message <> '') AS message, arg_max(host, delivery_id) FILTER (host <> '') AS host
FROM incidents WHERE {_HASH} IS NOT NULL GROUP BY 1""")
def incident_fold(spark: SparkSession, d: str) -> DataFrame:
    f = I.fold(load(spark, d, "incidents"), canonical_hash("fingerprint"))
    return f.select("fingerprint", "seen_count", F.unix_micros("first_detected_at").alias("first_detected_us"), F.unix_micros("last_detected_at").alias("last_detected_us"), "message", "host")


@query(f"""WITH k AS (SELECT delivery_id, {_HASH} AS h FROM incidents), n AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY delivery_id) AS n FROM k WHERE h IS NOT NULL)
SELECT delivery_id, n AS seen_count_now, CASE WHEN n = 1 THEN 'new' WHEN n - 1 > 1 AND (n - 1) % 10 = 0 THEN 'renotify_count' ELSE 'duplicate' END AS reason FROM n""")
def incident_sequence(spark: SparkSession, d: str) -> DataFrame:
    return I.sequence(load(spark, d, "incidents").select("delivery_id", "fingerprint"), canonical_hash("fingerprint")).select("delivery_id", "seen_count_now", "reason")


@query("""SELECT delivery_id, CASE WHEN state IS NULL THEN 'new' WHEN state = 'NOTIFIED' THEN 'already_notified' WHEN state = 'RESOLVED' AND detected_at IS NULL AND received_at IS NOT NULL THEN 'reopened'
WHEN state = 'RESOLVED' AND received_at <> detected_at THEN 'reopened' WHEN state = 'RESOLVED' THEN 'resolved_same_event' WHEN state = 'ESCALATED' AND last_notified_at IS NULL THEN 'escalated_retry'
WHEN seen_count > 1 AND seen_count % 10 = 0 THEN 'renotify_count' WHEN (floor(epoch(TIMESTAMPTZ '2026-02-01 00:00:00+00')) - floor(epoch(coalesce(last_notified_at, detected_at)))) / 3600.0 >= 24 THEN 'renotify_age' ELSE 'duplicate' END AS reason FROM incidents""")
def notify_decision(spark: SparkSession, d: str) -> DataFrame:
    """What each stored record would say to an event detected when the record was received, on a fixed day."""
    now = F.lit("2026-02-01T00:00:00Z").cast("timestamp")
    return load(spark, d, "incidents").select("delivery_id", I.decide(F.col("state"), F.col("seen_count"), F.col("detected_at"), F.col("last_notified_at"), F.col("received_at"), now).alias("reason"))


_BLOB = "lower(coalesce(message, '') || ' ' || coalesce(stack_trace, '') || ' ' || coalesce(raw_stderr_tail, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(tool, '') || ' ' || coalesce(module, ''))"
_ANY = lambda hints: "(" + " OR ".join("contains(b, '" + h.replace("'", "''") + "')" for h in hints) + ")"


@query(f"""WITH x AS (SELECT delivery_id, kind, tool, {_BLOB} AS b FROM incidents)
SELECT delivery_id, CASE WHEN kind = 'timeout' THEN 'host' WHEN {_ANY(I.HOST_HINTS)} THEN 'host' WHEN {_ANY(I.CODE_HINTS)} THEN 'code' ELSE 'host' END AS fault,
CASE WHEN tool = 'cron_pull_all' THEN 'pull_all' WHEN tool = 'cron_sync_backup' THEN 'backup' WHEN tool = 'api_gateway' THEN 'gateway' WHEN {_ANY(I.DISK_HINTS)} THEN 'disk' WHEN NOT contains(b, 'traceback') AND {_ANY(I.DATABASE_HINTS)} THEN 'database' END AS template FROM x""")
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    said = F.col("said")
    return load(spark, d, "incidents").select("delivery_id", "kind", "tool", I.blob(*I.SAID).alias("said")).select("delivery_id", I.fault(said, F.col("kind")).alias("fault"), I.template(F.col("tool"), said).alias("template"))


@query(r"""WITH m AS (SELECT *, coalesce(tool, '') AS t, coalesce(module, '') AS md, regexp_replace(regexp_replace(trim(coalesce(message, '')), '^\[ERR\]\s*', '', 'i'), '^Error:\s*', '', 'i') AS m FROM incidents),
h AS (SELECT *, regexp_extract(m, '(?i)^file not found:\s*(.+)', 1) AS missing, upper(substr(m, 1, 1)) || substr(m, 2) AS up FROM m)
SELECT delivery_id, substr(CASE WHEN starts_with(t, 'cron_') THEN replace(substr(t, 6), '_', ' ') WHEN md <> '' THEN replace(md, '-', ' ') WHEN t <> '' THEN replace(t, '_', ' ') ELSE 'a job' END || ' failed: ' ||
CASE WHEN kind = 'timeout' THEN 'The job timed out.' WHEN m IN ('', '(no stderr)') THEN CASE WHEN coalesce(returncode, 0) <> 0 THEN 'The script failed (exit code ' || returncode || ').' ELSE 'Something went wrong.' END
WHEN missing <> '' THEN 'Couldn''t find the file ' || trim(missing) || '.' WHEN starts_with(lower(m), 'traceback') THEN 'The script crashed.' WHEN ends_with(m, '.') THEN up ELSE up || '.' END || ' (ref ' || substr(coalesce(fingerprint, ''), 1, 8) || ')', 1, 320) AS text FROM h""")
def notification_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "incidents").select("delivery_id", I.notification(F.col("tool"), F.col("module"), F.col("message"), F.col("kind"), F.col("returncode"), F.coalesce("fingerprint", F.lit(""))).alias("text"))


@query("SELECT delivery_id, state, epoch_us(updated_at) AS updated_us FROM incidents WHERE state IN ('DETECTED', 'ESCALATED') ORDER BY updated_at DESC NULLS LAST, delivery_id LIMIT 50")
def open_newest(spark: SparkSession, d: str) -> DataFrame:
    """The fifty open records touched last."""
    return load(spark, d, "incidents").where("state IN ('DETECTED', 'ESCALATED')").select("delivery_id", "state", F.unix_micros("updated_at").alias("updated_us")).orderBy(F.desc_nulls_last("updated_us"), "delivery_id").limit(50)


@query(f"SELECT substr({_HASH}, 1, 8) AS prefix, count(DISTINCT {_HASH}) AS n FROM incidents WHERE {_HASH} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_HASH}) = 1")
def unique_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes that name exactly one fingerprint."""
    h = load(spark, d, "incidents").select(canonical_hash("fingerprint").alias("h")).where("h IS NOT NULL").distinct()
    return h.groupBy(F.substring("h", 1, 8).alias("prefix")).agg(F.count("*").alias("n")).where("n = 1")


@query("SELECT epoch_us(detected_at) // 86400000000 AS day, severity, count(*) AS n, count(DISTINCT tool) AS tools FROM incidents WHERE detected_at IS NOT NULL GROUP BY 1, 2")
def failures_by_day(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "incidents").where("detected_at IS NOT NULL").groupBy(F.floor(F.unix_micros("detected_at") / 86_400_000_000).cast("long").alias("day"), "severity").agg(F.count("*").alias("n"), F.countDistinct("tool").alias("tools"))


@query("SELECT tool, kind, count(*) AS n FROM incidents WHERE NOT (coalesce(tool, '') = 'cron_sync_backup' AND coalesce(kind, '') = 'timeout') GROUP BY 1, 2")
def noise_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Failures by tool and kind, less a job that is known to run long."""
    return I.without_known(load(spark, d, "incidents").select("tool", "kind"), (("cron_sync_backup", "timeout"),)).groupBy("tool", "kind").agg(F.count("*").alias("n"))


# --- checks ----------------------------------------------------------------------------------------------------------

CHECKS = [
    K.Check("max_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice < 0"),
    K.Check("min_rows", "SELECT c_custkey FROM customer", "min_rows", 10),
    K.Check("exact_rows", "SELECT r_regionkey FROM region", "exact_rows", 5),
    K.Check("min_scalar", "SELECT count(*) AS cnt FROM lineitem", "min_scalar", 1000),
    K.Check("baseline_delta", "SELECT count(*) AS cnt FROM orders", "baseline_delta_pct", threshold_pct=25),
    K.Check("writes", "DELETE FROM orders"),
]


@query("""WITH m AS (SELECT 'max_rows' AS check_id, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS row_count, 0.0 AS metric UNION ALL SELECT 'min_rows', (SELECT count(*) FROM customer), 0 UNION ALL SELECT 'exact_rows', (SELECT count(*) FROM region), 0
UNION ALL SELECT 'min_scalar', 1, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'baseline_delta', 1, (SELECT count(*) FROM orders) UNION ALL SELECT 'writes', NULL, NULL)
SELECT check_id, check_id <> 'writes' AS ok, CASE check_id WHEN 'max_rows' THEN row_count <= 0 WHEN 'min_rows' THEN row_count >= 10 WHEN 'exact_rows' THEN row_count = 5 WHEN 'min_scalar' THEN metric >= 1000
WHEN 'baseline_delta' THEN abs(metric - 10000) / 10000 * 100 <= 25 ELSE false END AS passed, row_count FROM m""")
def check_run(spark: SparkSession, d: str) -> DataFrame:
    """A run of six checks, one of which is refused because it writes."""
    register(spark, d, "orders", "customer", "region", "lineitem")
    base = spark.createDataFrame([("baseline_delta", 10000.0)], "check_id string, value double")
    r = K.run(spark, CHECKS, base)
    return r.select("check_id", "ok", F.coalesce("passed", F.lit(False)).alias("passed"), "row_count")


@query("""SELECT * FROM (VALUES ('regions', 'sql_rows', true), ('orders', 'sql_scalar', true), ('too_many', 'sql_rows', false)) t(id, kind, passed)""")
def golden_bounds(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders", "region", "nation")
    cases = [{"id": "regions", "kind": "sql_rows", "sql": "SELECT * FROM region", "expect": {"min_rows": 5, "max_rows": 5}}, {"id": "orders", "kind": "sql_scalar", "sql": "SELECT count(*) FROM orders", "expect": {"min_scalar": 1}},
             {"id": "too_many", "kind": "sql_rows", "sql": "SELECT * FROM nation", "expect": {"max_rows": 3}}]
    return K.golden(spark, cases).select("id", "kind", "passed")


@query("""WITH h AS (SELECT 'u' || (user_id % 5) AS check_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS run, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT check_id, count(*) AS runs, min(value) AS least, max(value) AS most FROM h GROUP BY 1""")
def check_history(spark: SparkSession, d: str) -> DataFrame:
    """Daily event counts of five user groups as a check's history, the newest hundred runs kept."""
    return K.retain(_history(spark, d)).groupBy("check_id").agg(F.count("*").alias("runs"), F.min("value").alias("least"), F.max("value").alias("most"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return load(spark, d, "events").groupBy(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("check_id"), day.alias("run")).agg(F.count("*").cast("double").alias("value"))


@query("""WITH RECURSIVE h AS (SELECT 'u' || (user_id % 5) AS check_id, date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS run, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY run) AS i FROM h),
b AS (SELECT check_id, run, value, i, NULL::DOUBLE AS baseline, true AS passed FROM o WHERE i = 1
  UNION ALL SELECT check_id, run, value, i, base, base = 0 OR abs(value - base) / abs(base) * 100 <= 10 FROM (SELECT o.*, CASE WHEN b.passed THEN b.value ELSE b.baseline END AS base FROM o JOIN b ON o.check_id = b.check_id AND o.i = b.i + 1))
SELECT check_id, run, value, baseline, passed FROM b""")
def check_rolling_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each day's count against the last passing day's."""
    return K.rolling_baseline(_history(spark, d), 10.0)


CYCLE = [K.Check("no_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice < 0"), K.Check("nations", "SELECT n_nationkey FROM nation", "max_rows", 3), K.Check("regions", "SELECT count(*) AS cnt FROM region", "baseline_delta_pct"),
         K.Check("few", "SELECT count(*) AS cnt FROM nation", "min_scalar", 1000)]
_REASONS = "(VALUES ('nations', 'count 25.0 > max 3.0'), ('few', 'scalar 25.0 < min 1000.0')) f(id, why)"


@query(f"""SELECT 'summary' AS part, 'failed' AS name, 2.0::DOUBLE AS value UNION ALL SELECT 'summary', 'passed', 2 UNION ALL SELECT 'baseline', 'regions', 5 UNION ALL SELECT 'history', id, v FROM (VALUES ('no_rows', 1), ('nations', 2), ('regions', 1), ('few', 1)) h(id, v)
UNION ALL SELECT 'anomaly', sha256('watchdog|' || id || '|' || why), CASE id WHEN 'nations' THEN 4 ELSE 1 END FROM {_REASONS}""")
def check_cycle(spark: SparkSession, d: str) -> DataFrame:
    """A whole check run with what it leaves behind: one anomaly seen three times before, one new, a baseline that moves, history."""
    register(spark, d, "orders", "nation", "region")
    seen = F.sha2(F.lit("watchdog|nations|count 25.0 > max 3.0"), 256)
    known = spark.range(1).select(seen.alias("fingerprint"), F.lit("ANOMALY_OPEN").alias("state"), F.lit(3).alias("seen_count"))
    now = F.lit("2026-02-01T00:00:00Z").cast("timestamp")
    base = spark.range(1).select(F.lit("regions").alias("check_id"), F.lit(5.5).alias("value"), now.alias("recorded_at"))
    past = spark.createDataFrame([("nations", 1, 25.0)], "check_id string, run long, value double")
    r = K.cycle(spark, CYCLE, base, known, past, now)
    part = lambda of, name, value, df: df.select(F.lit(of).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    total = r["summary"].select(F.explode(F.create_map(F.lit("passed"), "passed", F.lit("failed"), "failed")).alias("k", "v"))
    return (part("summary", F.col("k"), F.col("v"), total).unionByName(part("baseline", F.col("check_id"), F.col("value"), r["baselines"])).unionByName(part("anomaly", F.col("fingerprint"), F.col("seen_count"), r["anomalies"]))
            .unionByName(part("history", F.col("check_id"), F.col("n"), r["history"].groupBy("check_id").agg(F.count("*").alias("n")))))


_PASSTHROUGH = "SELECT n_name, count(*) AS customers, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1"


@query(_PASSTHROUGH)
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """Any reading statement, past the guard."""
    register(spark, d, "customer", "nation")
    return sqltext.run_read_only(spark, _PASSTHROUGH)
