"""Daily facts from events, dimensions from the star schema, and contracts."""

from pyspark.sql import functions as F

from ..functions.expr import micros
from ..operators import facts as O
from . import query, read

DAYS = """
days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'purchase') AS conversions, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'error') AS errors,
    CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 10000) AS BIGINT) ELSE 0 END) AS BIGINT) / 10000 AS revenue, count(*) AS fact_rows
  FROM events GROUP BY ALL)"""
SUMS = ("impressions", "clicks", "conversions")


def days(spark, sf_dir):
    return O.rollup_days(read(spark, sf_dir, "events"))


def _dated(df):
    """Dates as text, which both engines write alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})


@query(f"WITH {DAYS} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM days")
def fact_rollup_day(spark, sf_dir):
    return _dated(days(spark, sf_dir))


RATES = """round(clicks::DOUBLE / nullif(impressions, 0), 6) AS ctr, round(conversions::DOUBLE / nullif(clicks, 0), 6) AS cvr,
  round(conversions * 1000::DOUBLE / nullif(impressions, 0), 6) AS ipm, round(revenue / nullif(impressions, 0), 6) AS rpi"""


@query(f"WITH {DAYS} SELECT user_id, CAST(day AS VARCHAR) AS day, {RATES} FROM days")
def rates(spark, sf_dir):
    return _dated(O.with_rates(days(spark, sf_dir))).select("user_id", "day", "ctr", "cvr", "ipm", "rpi")


def _rolling(frame: str, order: str, name: str) -> str:
    columns = ", ".join(f"CAST(coalesce(sum({c}) OVER (PARTITION BY user_id ORDER BY {order} {frame.format(w=w)}), 0) AS BIGINT) AS {c}_{name}_{w}d" for w in (3, 7, 14) for c in SUMS)
    return f"WITH {DAYS} SELECT user_id, CAST(day AS VARCHAR) AS day, {columns} FROM days"


@query(_rolling("ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING", "day", "prev"))
def rolling_prev_rows(spark, sf_dir):
    out = O.rolling_previous(days(spark, sf_dir), SUMS)
    return _dated(out).select("user_id", "day", *[f"{c}_prev_{w}d" for w in (3, 7, 14) for c in SUMS])


@query(_rolling("RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING", "date_diff('day', DATE '1970-01-01', day)", "cal"))
def rolling_prev_calendar(spark, sf_dir):
    out = O.rolling_previous(days(spark, sf_dir), SUMS, calendar=True)
    return _dated(out).select("user_id", "day", *[f"{c}_cal_{w}d" for w in (3, 7, 14) for c in SUMS])


def _early() -> str:
    columns = []
    for w in (3, 7, 14):
        inside = f"FILTER (age < {w})"
        columns += [f"count(*) {inside} AS first_{w}d_active_days"] + [f"CAST(coalesce(sum({c}) {inside}, 0) AS BIGINT) AS first_{w}d_{c}" for c in SUMS]
        columns += [f"round(stddev_samp(clicks::DOUBLE / nullif(impressions, 0)) {inside}, 6) AS first_{w}d_ctr_std", f"round((sum(clicks) {inside})::DOUBLE / nullif(sum(impressions) {inside}, 0), 6) AS first_{w}d_ctr"]
    return f"WITH {DAYS}, aged AS (SELECT *, date_diff('day', min(day) OVER (PARTITION BY user_id), day) AS age FROM days) SELECT user_id, {', '.join(columns)} FROM aged GROUP BY user_id"


@query(_early())
def early_windows(spark, sf_dir):
    return O.early_windows(days(spark, sf_dir))


LIFE = f"""life AS (
  SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS active_days, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(conversions) AS BIGINT) AS conversions,
    CAST(sum(fact_rows) AS BIGINT) AS fact_rows, CAST(sum(CAST(round(revenue * 10000) AS BIGINT)) AS BIGINT) / 10000 AS revenue, max(impressions) AS peak_day_impressions FROM days GROUP BY user_id),
lifecycle AS (SELECT *, {RATES}, CAST(date_diff('day', first_day, last_day) + 1 AS INT) AS span_days FROM life)"""


@query(f"WITH {DAYS}, {LIFE} SELECT * REPLACE (CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day) FROM lifecycle")
def lifecycle_kpis(spark, sf_dir):
    return _dated(O.lifecycle(days(spark, sf_dir)))


@query(f"WITH {DAYS}, {LIFE}, early AS ({_early().split(DAYS + ',', 1)[1].replace('aged AS', 'WITH aged AS', 1).strip()}) SELECT l.user_id, l.active_days, l.ctr, e.first_3d_ctr, e.first_7d_clicks, e.first_14d_ctr_std FROM lifecycle l LEFT JOIN early e ON l.user_id = e.user_id")
def feature_base(spark, sf_dir):
    base = days(spark, sf_dir)
    early = O.early_windows(base).select("user_id", "first_3d_ctr", "first_7d_clicks", "first_14d_ctr_std")
    return O.lifecycle(base).select("user_id", "active_days", "ctr").join(early, "user_id", "left")


@query("SELECT s_suppkey, s_name, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_enrich(spark, sf_dir):
    nation = O.assert_unique(read(spark, sf_dir, "nation"), ("n_nationkey",), "nation")
    out = O.enrich(read(spark, sf_dir, "supplier"), nation, {"s_nationkey": "n_nationkey"}, {"n_name": "nation", "n_regionkey": "n_regionkey"})
    out = O.enrich(out, read(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}, {"r_name": "region"})
    return out.select("s_suppkey", "s_name", "nation", "region")


@query("SELECT l_orderkey, l_linenumber, p_brand AS brand, p_type AS kind, s_name AS supplier FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def fact_enrich(spark, sf_dir):
    return _fact_enrich(spark, sf_dir, read(spark, sf_dir, "lineitem"))


def _fact_enrich(spark, sf_dir, li):
    out = O.enrich(li, read(spark, sf_dir, "part"), {"l_partkey": "p_partkey"}, {"p_brand": "brand", "p_type": "kind"})
    out = O.enrich(out, read(spark, sf_dir, "supplier"), {"l_suppkey": "s_suppkey"}, {"s_name": "supplier"})
    return out.select("l_orderkey", "l_linenumber", "brand", "kind", "supplier")


RELATIONS = [("orders", "customer", "o_custkey", "c_custkey"), ("lineitem", "orders", "l_orderkey", "o_orderkey"), ("lineitem", "part", "l_partkey", "p_partkey"), ("labels", "documents", "doc_id", "doc_id"), ("documents", "labels", "doc_id", "doc_id")]


def _coverage(left, right, a, b) -> str:
    return f"SELECT '{left}.{a}->{right}.{b}' AS relation, count(*) AS left_keys, count(*) - count(known) AS missing_keys, round(count(known)::DOUBLE / nullif(count(*), 0), 6) AS coverage FROM (SELECT DISTINCT {a} AS k FROM {left} WHERE {a} IS NOT NULL) LEFT JOIN (SELECT DISTINCT {b} AS k, 1 AS known FROM {right}) USING (k)"


@query(" UNION ALL ".join(_coverage(*r) for r in RELATIONS))
def fk_coverage(spark, sf_dir):
    out = None
    for left, right, a, b in RELATIONS:
        one = O.foreign_key_coverage(read(spark, sf_dir, left), read(spark, sf_dir, right), a, b, f"{left}.{a}->{right}.{b}")
        out = one if out is None else out.unionByName(one)
    return out


KEYS = [("lineitem", ("l_orderkey", "l_linenumber")), ("lineitem", ("l_orderkey",)), ("orders", ("o_orderkey",)), ("documents", ("doc_id",)), ("conversations", ("conv_id", "turn"))]


def _unique(table, keys) -> str:
    nulls = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"SELECT '{table}' AS table_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count, count(*) AS distinct_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(CASE WHEN {nulls} THEN n ELSE 0 END), 0) AS BIGINT) AS null_key_rows FROM (SELECT {', '.join(keys)}, count(*) AS n FROM {table} GROUP BY ALL)"


@query(" UNION ALL ".join(_unique(*k) for k in KEYS))
def unique_key_report(spark, sf_dir):
    out = None
    for table, keys in KEYS:
        one = O.unique_key_report(read(spark, sf_dir, table), keys, table)
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH r AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 10000) AS BIGINT)) AS BIGINT) / 10000 AS o_totalprice FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o.o_orderkey IS NULL AS right_only, r.o_orderkey IS NULL AS left_only, o.o_totalprice AS a, r.o_totalprice AS b FROM orders o FULL JOIN r ON o.o_orderkey = r.o_orderkey)
SELECT 'o_totalprice' AS metric, count(*) FILTER (left_only) AS left_only, count(*) FILTER (right_only) AS right_only, count(*) FILTER (NOT left_only AND NOT right_only AND (a IS NULL) <> (b IS NULL)) AS null_mismatches,
  count(*) FILTER (NOT left_only AND NOT right_only AND abs(a - b) > 0.02) AS bad_rows, round(max(abs(a - b)) FILTER (NOT left_only AND NOT right_only), 6) AS max_gap FROM j""")
def summary_reconcile(spark, sf_dir):
    again = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(micros(F.col("l_extendedprice"))) / 10000).alias("o_totalprice"))
    return O.reconcile(read(spark, sf_dir, "orders"), again, "o_orderkey", {"o_totalprice": 0.02})


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS n FROM labels) WHERE n = 1")
def dedup_keep_first(spark, sf_dir):
    return O.keep_first(read(spark, sf_dir, "labels"), ("quality", "toxic"), (F.asc("doc_id"),)).select("doc_id", "quality")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return O.not_yet_done(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT s_nationkey AS nation, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL BY NAME SELECT c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def union_by_name(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    b = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY o_orderstatus), 4) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def value_counts(spark, sf_dir):
    from pyspark.sql import Window

    n = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus")), 4))


@query("SELECT p_brand, p_type, count(DISTINCT p_size) AS sizes, median(p_retailprice) AS mid_price, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END), 6) AS large_share, count(*) AS n FROM part GROUP BY ALL HAVING count(*) >= 10")
def category_performance(spark, sf_dir):
    out = read(spark, sf_dir, "part").groupBy("p_brand", "p_type")
    return out.agg(F.countDistinct("p_size").alias("sizes"), F.median("p_retailprice").alias("mid_price"), F.round(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)), 6).alias("large_share"), F.count("*").alias("n")).where("n >= 10")


@query("PIVOT (SELECT c_mktsegment, c_nationkey % 3 AS zone, c_acctbal FROM customer) ON zone IN (0, 1, 2) USING median(c_acctbal) GROUP BY c_mktsegment")
def pivot_median(spark, sf_dir):
    return read(spark, sf_dir, "customer").withColumn("zone", F.pmod("c_nationkey", F.lit(3))).groupBy("c_mktsegment").pivot("zone", [0, 1, 2]).agg(F.median("c_acctbal"))


@query("SELECT l_returnflag, p_type AS mode_type, p_size AS mode_size FROM (SELECT l_returnflag, p_type, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_type) t JOIN (SELECT l_returnflag, p_size, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, p_size) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_size) s USING (l_returnflag) WHERE t.k = 1 AND s.k = 1")
def mode_by_group(spark, sf_dir):
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("l_returnflag").agg(F.mode("p_type", True).alias("mode_type"), F.mode("p_size", True).alias("mode_size"))


@query("SELECT l_returnflag, l_linestatus, round(CASE WHEN sum(CASE WHEN l_discount > 0 THEN l_quantity END) > 0 THEN sum(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END) / sum(CASE WHEN l_discount > 0 THEN l_quantity END) ELSE avg(CASE WHEN l_discount > 0 THEN l_discount END) END, 6) AS mean_discount FROM lineitem GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    from ..functions.expr import weighted_mean as mean

    some = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(mean(some, F.col("l_quantity")), 6).alias("mean_discount"))


@query("SELECT user_id, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(DISTINCT json_extract_string(props, '$.k')) AS k_values FROM events GROUP BY user_id")
def json_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.sum(k.try_cast("bigint")).alias("k_sum"), F.countDistinct(k).alias("k_values"))
