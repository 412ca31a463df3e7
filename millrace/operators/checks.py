"""Data-quality checks: SQL reduced to a number, asserted, held against baselines and golden bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from millrace.functions.text import number_of
from millrace.session import cut_lineage
from millrace.sources import sqltext

SAMPLE_ROWS, THRESHOLD_PCT = 5, 25.0
# Columns a metric is taken from first.
METRIC_COLUMNS = ("cnt", "count", "total_revenue", "total", "value")


@dataclass(frozen=True)
class Check:
    id: str
    sql: str
    assertion: str = "max_rows"
    threshold: float | None = None
    threshold_pct: float | None = None
    severity: str = "warning"
    preamble: str | None = None
    message_template: str | None = None


def scalar(df: DataFrame, mode: str = "rows") -> Column:
    """The first row's metric as a double.

    mode 'compat': a single column is the metric, 0 if it is no number; of several, the first named in METRIC_COLUMNS,
    else the first number or text that reads as one. mode 'rows': only a single numeric column is a metric.
    """
    fields = df.schema.fields
    num = lambda f: F.col(f"`{f.name}`").try_cast("double")
    numeric = lambda f: isinstance(f.dataType, T.NumericType)
    if len(fields) == 1:
        return F.coalesce(num(fields[0]), F.lit(0.0)) if mode == "compat" or numeric(fields[0]) else F.lit(None).cast("double")
    if mode == "rows":
        return F.lit(None).cast("double")
    named = [num(f) for n in METRIC_COLUMNS for f in fields if f.name == n]
    other = [num(f) if numeric(f) else number_of(F.col(f"`{f.name}`")) for f in fields if numeric(f) and not isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.StringType)]
    return F.coalesce(*named, *other, F.lit(1.0))


def measure(df: DataFrame, mode: str = "rows") -> DataFrame:
    """(row_count, metric_value, sample_rows): one row; rows are counted, not fetched, and the sample is the first few by their JSON."""
    part = df.select(scalar(df, mode).alias("m"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("r"))
    sample = part.select("r").orderBy("r").limit(SAMPLE_ROWS).agg(F.array_sort(F.collect_list("r")).alias("sample_rows"))
    total = part.agg(F.count(F.lit(1)).alias("row_count"), F.first("m", ignorenulls=True).alias("m"))
    metric = F.coalesce(F.when(F.col("row_count") == 1, F.col("m")), F.when((F.col("row_count") == 0) & F.lit(mode == "compat"), 0.0), F.col("row_count").cast("double"))
    return total.select("row_count", metric.alias("metric_value"), sample.scalar().alias("sample_rows"))


def verdict(assertion: Column, metric: Column, rows: Column, threshold: Column, pct: Column, baseline: Column) -> Column:
    """struct<passed, reason>: null thresholds take their defaults, an explicit 0 stays 0; unknown assertions pass."""
    limit0, limit1, share = F.coalesce(threshold, F.lit(0.0)), F.coalesce(threshold, F.lit(1.0)), F.coalesce(pct, F.lit(THRESHOLD_PCT))
    effective = F.when(rows > 1, rows.cast("double")).otherwise(metric)
    known = baseline.isNotNull() & (baseline != 0)
    delta = F.when(known, F.abs(metric - baseline) / F.abs(baseline) * 100.0)
    passed = (F.when(assertion == "max_rows", effective <= limit0).when(assertion == "min_rows", rows >= limit1).when(assertion == "exact_rows", rows == limit1).when(assertion == "min_scalar", metric >= limit1)
              .when(assertion == "baseline_delta_pct", F.when(known, delta <= share).otherwise(True)).otherwise(True))
    say = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    reason = (F.when(assertion == "max_rows", say("count ", effective, " > max ", limit0)).when(assertion == "min_rows", say("rows ", rows, " < min ", limit1)).when(assertion == "exact_rows", say("rows ", rows, " <> ", limit1))
              .when(assertion == "min_scalar", say("scalar ", metric, " < min ", limit1)).when((assertion == "baseline_delta_pct") & ~known, "baseline established")
              .when(assertion == "baseline_delta_pct", say("delta ", F.round(delta, 2), "% > ", share, "%")).otherwise("unknown assertion (skipped)"))
    return F.struct(passed.alias("passed"), reason.alias("reason"))


def run(spark: SparkSession, checks: list[Check], baselines: DataFrame | None = None, mode: str = "rows") -> DataFrame:
    """One row a check. A check whose SQL fails or writes is reported with its error and stops no other."""
    results = None
    for c in checks:
        head = [F.lit(c.id).alias("check_id"), F.lit(c.assertion).alias("assertion"), F.lit(c.threshold).cast("double").alias("threshold"), F.lit(c.threshold_pct).cast("double").alias("threshold_pct"), F.lit(c.severity).alias("severity")]
        try:
            if c.preamble:
                sqltext.run_read_only(spark, c.preamble, allow_session=True)
            one = measure(sqltext.run_read_only(spark, c.sql), mode).select(*head, F.lit(None).cast("string").alias("error"), "row_count", "metric_value", "sample_rows")
        except Exception as e:  # noqa: BLE001 - any failure of a check is its result
            one = spark.range(1).select(*head, F.lit(str(e)[:500]).alias("error"), F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("double").alias("metric_value"), F.array().cast("array<string>").alias("sample_rows"))
        results = one if results is None else results.unionByName(one)
    base = baselines.select("check_id", F.col("value").alias("baseline_value")) if baselines is not None else spark.createDataFrame([], "check_id string, baseline_value double")
    j = results.join(base, "check_id", "left")
    v = verdict(F.col("assertion"), F.col("metric_value"), F.col("row_count"), F.col("threshold"), F.col("threshold_pct"), F.col("baseline_value"))
    ok = F.col("error").isNull()
    return j.withColumn("v", v).select("check_id", ok.alias("ok"), (ok & F.col("v.passed")).alias("passed"), "error", "metric_value", "row_count", "baseline_value", F.when(ok, F.col("v.reason")).alias("reason"), "severity",
                                       F.when(ok & ~F.col("v.passed"), F.col("sample_rows")).otherwise(F.array().cast("array<string>")).alias("sample_rows"))


def new_baselines(results: DataFrame, baselines: DataFrame, assertions: list[Check], now: Column) -> DataFrame:
    """Baselines after a run: a passing delta check moves its baseline to the current metric, a failing one keeps it."""
    ids = [c.id for c in assertions if c.assertion == "baseline_delta_pct"]
    moved = results.where(F.col("check_id").isin(*ids) & F.col("passed")).select("check_id", F.col("metric_value").alias("value"), now.alias("recorded_at"))
    return baselines.join(moved.select("check_id"), "check_id", "left_anti").unionByName(moved)


def rolling_baseline(history: DataFrame, pct: float = THRESHOLD_PCT) -> DataFrame:
    """Every run of each check with the baseline it met and whether it passed: a fold over the runs in order.

    history: check_id, run (orders the runs), value. One check's runs are a bounded series (RETAINED at most).
    """
    runs = history.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("run", "value"))).alias("r"))
    zero = F.struct(F.lit(None).cast("double").alias("base"), F.array().cast("array<struct<run:bigint,value:double,baseline:double,passed:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        known = s.base.isNotNull() & (s.base != 0)
        ok = ~known | (F.abs(x.value - s.base) / F.abs(s.base) * 100.0 <= pct)
        row = F.struct(x.run.cast("long").alias("run"), x.value.cast("double").alias("value"), s.base.alias("baseline"), ok.alias("passed"))
        return F.struct(F.when(ok, x.value.cast("double")).otherwise(s.base).alias("base"), F.concat(s.out, F.array(row)).alias("out"))

    return runs.select("check_id", F.explode(F.aggregate("r", zero, step, lambda s: s.out)).alias("x")).select("check_id", "x.*")


RETAINED = 100


def retain(history: DataFrame, order: str = "run", most: int = RETAINED) -> DataFrame:
    """The newest runs of each check."""
    return history.withColumn("__n", F.row_number().over(W.partitionBy("check_id").orderBy(F.desc(order)))).where(F.col("__n") <= most).drop("__n")


def golden(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """(id, kind, passed, scalar, rows): sql_scalar cases by their least value, sql_rows cases by their row bounds."""
    out = None
    for c in cases:
        e = c.get("expect", {})
        m = measure(sqltext.run_read_only(spark, c["sql"]), "compat")
        if c["kind"] == "sql_scalar":
            passed = F.col("metric_value") >= float(e.get("min_scalar", 0))
        else:
            passed = F.col("row_count").between(int(e.get("min_rows", 1)), int(e.get("max_rows", 999_999)))
        one = m.select(F.lit(c["id"]).alias("id"), F.lit(c["kind"]).alias("kind"), passed.alias("passed"), F.col("metric_value").alias("scalar"), F.col("row_count").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count("*").alias("total"))


def fill(template: Column, **values: Column) -> Column:
    """A message template with its {names} filled in."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("None")))
    return template


def anomaly_fingerprint(check_id: Column, metric: Column, reason: Column | None = None) -> Column:
    """One anomaly's identity: its check and its reason, or the metric to four digits where no reason is given."""
    sign = F.format_string("%.4f", metric) if reason is None else F.when(F.coalesce(reason, F.lit("")) != "", F.substring(reason, 1, 120)).otherwise(F.format_string("%.4f", metric))
    return F.sha2(F.concat(F.lit("watchdog|"), check_id, F.lit("|"), sign), 256)


def anomalies(results: DataFrame, known: DataFrame) -> DataFrame:
    """Failed checks as anomalies: fingerprint, times seen so far, and whether it is new. known: fingerprint, state, seen_count."""
    failed = results.where(~F.col("passed")).withColumn("fingerprint", anomaly_fingerprint(F.col("check_id"), F.coalesce("metric_value", F.lit(0.0)), F.coalesce("reason", "error")))
    k = known.select("fingerprint", F.col("state").alias("__state"), F.col("seen_count").alias("__seen"))
    j = failed.join(k, "fingerprint", "left")
    fresh = F.col("__state").isNull() | F.col("__state").isin("ANOMALY_RESOLVED", "RESOLVED")
    return j.select("fingerprint", "check_id", "severity", "metric_value", "reason", F.when(fresh, 1).otherwise(F.col("__seen") + 1).alias("seen_count"), fresh.alias("new"))


def cycle(spark: SparkSession, checks: list[Check], baselines: DataFrame, known: DataFrame, history: DataFrame, now: Column, mode: str = "rows") -> dict[str, DataFrame]:
    """A whole run: `results`, the `baselines` after it, `anomalies` with how often each was seen, the `history` kept, a `summary`.

    The results are computed once; nothing is stored here, so a run that dies leaves everything as it was.
    known: fingerprint, state, seen_count; history: check_id, run (epoch seconds of the run), value.
    """
    results = cut_lineage(run(spark, checks, baselines, mode))
    values = results.where("ok").select("check_id", F.unix_seconds(now).alias("run"), F.col("metric_value").alias("value"))
    return {"results": results, "baselines": new_baselines(results, baselines, checks, now), "anomalies": anomalies(results, known),
            "history": retain(history.select("check_id", "run", "value").unionByName(values)), "summary": summary(results)}


def golden_cases(rows: DataFrame, repo: str | None = None) -> list[dict]:
    """Cases kept as a table (id, repo, kind, sql, and the bounds min_scalar, min_rows, max_rows); all of them, or a repository's."""
    rows = rows if repo is None else rows.where(F.coalesce("repo", F.lit("")) == repo)
    return [{"id": r.id, "kind": r.kind, "sql": r.sql, "expect": {k: r[k] for k in ("min_scalar", "min_rows", "max_rows") if r[k] is not None}} for r in rows.orderBy("id").collect()]  # a stated list of cases
