"""Relational coverage: joins, grouping, windows, set operations and functions over the sales and event tables.

Each query is a declarative plan, with a SQL text that says the same. Sides are broadcast by the optimizer's own size
check; nothing here forces one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.tables import load, register

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name beside its SQL text."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    # orders are counted by customer before the join: one row a customer crosses it, however skewed the orders are
    n = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return load(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT coalesce(a.k, b.k) AS nationkey, a.n AS customers, b.n AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nationkey", "full")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, band FROM part JOIN (VALUES ('low', 0, 1000), ('mid', 1000, 1500), ('high', 1500, 1000000)) b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    """A table of three bands, small by its making, met by a condition other than equality."""
    bands = spark.createDataFrame([("low", 0.0, 1000.0), ("mid", 1000.0, 1500.0), ("high", 1500.0, 1000000.0)], "band string, lo double, hi double")
    p = load(spark, d, "part").select("p_partkey", "p_retailprice")
    return p.join(F.broadcast(bands), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).select("p_partkey", "band")


@query("SELECT r_name, season FROM region, (VALUES ('winter'), ('spring'), ('summer'), ('autumn')) s(season)")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    """Regions, of which there are five whatever the scale, by the four seasons."""
    seasons = spark.createDataFrame([(x,) for x in ("winter", "spring", "summer", "autumn")], "season string")
    return load(spark, d, "region").crossJoin(F.broadcast(seasons)).select("r_name", "season")


@query("""SELECT v.event_id, count(*) AS errors_before FROM events v JOIN events e ON e.user_id = v.user_id AND e.event_type = 'error' AND e.ts <= v.ts AND e.ts >= v.ts - INTERVAL 1 HOUR
WHERE v.event_type = 'purchase' GROUP BY v.event_id""")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    """Errors in the hour before each purchase: a running count over a time range, so no pairs are formed."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    w = W.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)
    n = F.sum((F.col("event_type") == "error").cast("int")).over(w)
    return e.where("event_type IN ('error', 'purchase')").withColumn("errors_before", n).where("event_type = 'purchase' AND errors_before > 0").select("event_id", "errors_before")


@query("""SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Last click at or before each purchase: one sort by user and time, no pairs."""
    e = load(spark, d, "events").where("event_type IN ('purchase', 'click')")
    click = F.col("event_type") == "click"
    w = W.partitionBy("user_id").orderBy("ts", F.when(click, 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    return (e.withColumn("click_id", F.last(F.when(click, F.col("event_id")), ignorenulls=True).over(w))
            .where("event_type = 'purchase'").select("event_id", "click_id"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_group(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")  # exact sums, whatever the order of the rows
    disc = price * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
            .agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).cast("double").alias("sum_base"), F.sum(disc).cast("double").alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n")))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS gid, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"


@query(_SETS)
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "orders")
    return spark.sql(_SETS)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)
    return t.toDF("o_orderpriority", "f", "o", "p")


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey")
    return load(spark, d, "orders").select("o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).alias("r"), F.dense_rank().over(w.orderBy("o_orderpriority")).alias("dr"),
                                           F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"))


@query("SELECT event_id, lag(event_id) OVER w AS prev_id, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_type").over(w).alias("next_type"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM events")
def win_running(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return load(spark, d, "events").select("event_id", F.count("*").over(w).alias("n_so_far"))


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS max3 FROM orders")
def win_frame_rows(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return load(spark, d, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("max3"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM events")
def win_frame_range(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return e.select("event_id", F.count("*").over(W.partitionBy("user_id").orderBy("t").rangeBetween(-86_400_000_000, 0)).alias("n_day"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")), load(spark, d, "orders").select(F.col("o_custkey").alias("k"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.unionByName(b)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return b.exceptAll(a)


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substr(p_name, 1, 5) AS head, replace(p_brand, '#', '-') AS brand,
regexp_extract(p_type, '^(\\w+)', 1) AS kind, lpad(CAST(p_size AS VARCHAR), 4, '0') AS size4, concat_ws('|', p_brand, p_type) AS both FROM part""")
def fn_string(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("len"), F.substring("p_name", 1, 5).alias("head"),
                                         F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.regexp_extract("p_type", r"^(\w+)", 1).alias("kind"),
                                         F.lpad(F.col("p_size").cast("string"), 4, "0").alias("size4"), F.concat_ws("|", "p_brand", "p_type").alias("both"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day,
CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS due, strftime(o_orderdate, '%Y%m%d-%H%M%S') AS stamp, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS age FROM orders""")
def fn_date(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.trunc(t, "month").alias("first_day"), F.date_add(t.cast("date"), 90).alias("due"),
                                           F.date_format(t, "yyyyMMdd-HHmmss").alias("stamp"), F.datediff(t.cast("date"), F.lit("1992-01-01").cast("date")).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 1000) AS thousands, l_extendedprice * l_discount AS off, least(greatest(l_quantity, 10), 40) AS clamped,
CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS unit, CAST(floor(l_extendedprice) AS BIGINT) % 7 AS m FROM lineitem""")
def fn_math(spark: SparkSession, d: str) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(p / 1000).cast("double").alias("thousands"), (p * F.col("l_discount")).alias("off"),
                                             F.least(F.greatest(q, F.lit(10.0)), F.lit(40.0)).alias("clamped"), F.try_divide(p, q).alias("unit"), (F.floor(p).cast("long") % 7).alias("m"))


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2, embedding[1] AS head, list_slice(embedding, 1, 3) AS first3 FROM embeddings")
def fn_array(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double") * x)
    return load(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 4).alias("norm2"),
                                               F.element_at("embedding", 1).alias("head"), F.slice("embedding", 1, 3).alias("first3"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, props IS NOT NULL AS has FROM events")
def fn_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.from_json("props", "k int").k.alias("k"), F.col("props").isNotNull().alias("has"))


@query("SELECT event_type, map_from_entries(list((user_id, n) ORDER BY user_id)) AS by_user FROM (SELECT event_type, user_id % 5 AS user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def fn_map(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("u")).agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("u", "n")))).alias("by_user"))


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.withColumn("a", F.avg("o_totalprice").over(W.partitionBy("o_custkey"))).where("o_totalprice > 1.5 * a").select("o_orderkey", "o_totalprice")


_CTE = """WITH rev AS (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_suppkey), top AS (SELECT max(revenue) AS m FROM rev)
SELECT s_suppkey, s_name, revenue FROM supplier JOIN rev ON s_suppkey = l_suppkey WHERE revenue >= 0.9 * (SELECT m FROM top)"""


@query(_CTE)
def cte_chain(spark: SparkSession, d: str) -> DataFrame:
    register(spark, d, "lineitem", "supplier")
    return spark.sql(_CTE)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming import windows
    return windows.tumbling(load(spark, d, "events"))


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * i) MINUTE AS start, event_type, count(*) AS n FROM events, range(4) r(i) GROUP BY 1, 2""")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming import windows
    return windows.sliding(load(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming import windows
    return windows.sessions(load(spark, d, "events"))
