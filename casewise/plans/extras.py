"""Join contracts, splits, column tools, brief scoring and layout over the driver's tables."""

from pyspark.sql import functions as F

from ..functions.expr import clip
from ..operators import columns as C
from ..operators import facts as O
from ..operators import geometry as G
from ..operators import joins as J
from ..sources.scratch import Scratch
from . import query, read
from .facts import DAYS, days
from .ranking import CASES, HEALTH, RANKING, cases, healthy, ranked


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN (SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality) AS n FROM labels) WHERE n = 1) l ON d.doc_id = l.doc_id")
def join_left(spark, sf_dir):
    return J.join_tables(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", "left", (F.asc("quality"),)).select("doc_id", "lang", "quality")


@query("SELECT coalesce(s.k, c.k) AS k, s.s_name, c.c_name FROM (SELECT s_suppkey AS k, s_name FROM supplier) s FULL JOIN (SELECT c_custkey AS k, c_name FROM customer) c ON s.k = c.k")
def join_outer(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return J.join_tables(s, c, "k", "outer")


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 1 END, l.toxic) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_backfill(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) != 0, 1).alias("toxic"))
    return J.backfill(d, read(spark, sf_dir, "labels"), "doc_id", ("toxic",))


@query("SELECT count(*) FILTER (list_contains(string_split('AUTOMOBILE|BUILDING', '|'), c_mktsegment)) AS targeted, count(*) AS customers FROM customer")
def targeting_check(spark, sf_dir):
    found = J.membership(F.col("c_mktsegment"), F.lit("AUTOMOBILE|BUILDING"))
    return read(spark, sf_dir, "customer").agg(F.count(F.when(found, 1)).alias("targeted"), F.count("*").alias("customers"))


@query("SELECT count(*) AS facts, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) FILTER (d.doc_id IS NOT NULL AND l.quality IS DISTINCT FROM d.quality) AS inconsistent FROM labels l LEFT JOIN (SELECT doc_id, 1 AS quality FROM documents) d ON l.doc_id = d.doc_id")
def fact_consistency(spark, sf_dir):
    dim = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("quality"))
    return J.consistency(read(spark, sf_dir, "labels"), dim, "doc_id", "quality")


@query("SELECT 'labels' AS family, count(coalesce(quality, toxic)) AS covered, count(*) AS row_count, round(count(coalesce(quality, toxic))::DOUBLE / count(*), 6) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def family_coverage(spark, sf_dir):
    both = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return J.coverage(both, {"labels": ("quality", "toxic")})


@query("SELECT s_nationkey, avg(s_suppkey) AS s_suppkey, min_by(s_name, s_suppkey) AS s_name, round(avg(s_acctbal), 4) AS s_acctbal FROM supplier GROUP BY s_nationkey")
def dup_policy_aggregate(spark, sf_dir):
    out = J.duplicate_policy(read(spark, sf_dir, "supplier"), "s_nationkey", "aggregate", (F.col("s_suppkey"),))
    return out.select("s_nationkey", "s_suppkey", "s_name", F.round("s_acctbal", 4).alias("s_acctbal"))


@query("SELECT event_id, row_number() OVER (ORDER BY date_trunc('second', ts), event_id) <= greatest(3, CAST(floor(0.8 * (SELECT count(*) FROM events)) AS BIGINT)) AS is_train FROM events")
def temporal_split(spark, sf_dir):
    return J.temporal_split(read(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "is_train")


@query("SELECT count(DISTINCT user_id) AS users, 0 AS split_users, 5 AS folds, count(*) AS events FROM events WHERE user_id IS NOT NULL")
def group_folds(spark, sf_dir):
    """What holds whatever the hash: each user's events lie in one fold, and no event is lost."""
    dealt = J.folds(read(spark, sf_dir, "events").where("user_id IS NOT NULL"), 5, "user_id")
    users = dealt.groupBy("user_id").agg(F.countDistinct("fold").alias("in_folds"), F.collect_set("fold").alias("which"), F.count("*").alias("n"))
    return users.agg(F.count("*").alias("users"), F.coalesce(F.sum((F.col("in_folds") > 1).cast("int")), F.lit(0)).cast("int").alias("split_users"), F.size(F.array_distinct(F.flatten(F.collect_set("which")))).alias("folds"), F.sum("n").alias("events"))


@query("SELECT role, string_agg(column_name, ',' ORDER BY column_name) AS names FROM (VALUES ('p_partkey', 'identifier'), ('p_name', 'text'), ('p_brand', 'text'), ('p_type', 'text'), ('p_size', 'number'), ('p_retailprice', 'number')) t(column_name, role) GROUP BY role")
def column_roles(spark, sf_dir):
    found = C.column_dictionary(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), spark)
    return found.groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("names"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_defaults(spark, sf_dir):
    return C.flattened(read(spark, sf_dir, "events"), "props", {"k": ("$.k", "int", -1), "missing": ("$.missing", "string", "none")}).select("event_id", "k", "missing")


@query("SELECT o_orderstatus, string_agg(o_orderpriority || '=' || CAST(round(n::DOUBLE / total, 4) AS VARCHAR), ',' ORDER BY o_orderpriority) AS mix FROM (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS total FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY o_orderstatus")
def status_mix(spark, sf_dir):
    out = C.shares(read(spark, sf_dir, "orders"), ("o_orderstatus",), "o_orderpriority")
    text = F.array_join(F.transform(F.map_entries("mix"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("o_orderstatus", text.alias("mix"))


def _describe(c: str) -> str:
    return f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS deviation, min({c})::DOUBLE AS least, round(quantile_cont({c}, 0.25), 5) AS p25, round(quantile_cont({c}, 0.5), 5) AS p50, round(quantile_cont({c}, 0.75), 5) AS p75, max({c})::DOUBLE AS greatest FROM lineitem"


@query(" UNION ALL ".join(map(_describe, ("l_quantity", "l_discount", "l_tax"))))
def describe_numbers(spark, sf_dir):
    return C.describe(read(spark, sf_dir, "lineitem"), ("l_quantity", "l_discount", "l_tax"))


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INT) AS place FROM part GROUP BY {c}) WHERE place <= 5" for c in ("p_brand", "p_type", "p_size")))
def most_frequent_values(spark, sf_dir):
    return C.most_frequent(read(spark, sf_dir, "part"), ("p_brand", "p_type", "p_size"))


@query("SELECT user_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def group_entropy(spark, sf_dir):
    return C.entropy(read(spark, sf_dir, "events"), ("user_id",), "event_type")


@query(f"WITH {DAYS} SELECT round(avg((clicks = coalesce(a, 0))::INT), 6) AS earlier_share, round(avg((clicks = coalesce(b, 0))::INT), 6) AS upto_share, round(avg((clicks = coalesce(c, 0))::INT), 6) AS before_share FROM (SELECT clicks, sum(impressions) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, sum(impressions) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b, lag(impressions) OVER (PARTITION BY user_id ORDER BY day) AS c FROM days)")
def sequence_audit(spark, sf_dir):
    return C.sequence_audit(days(spark, sf_dir), "user_id", "day", "clicks", "impressions")


@query("SELECT s_suppkey, round(CASE WHEN hi > lo THEN 2 * (s_acctbal - lo) / (hi - lo) - 1 ELSE 0 END, 6) AS scaled FROM supplier, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)")
def scaled_coordinates(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    edge = s.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), 2 * (F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1).otherwise(0.0)
    return s.crossJoin(F.broadcast(edge)).select("s_suppkey", F.round(scaled, 6).alias("scaled"))


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '(\\d+)$', 1), '') AS BIGINT) AS number FROM customer")
def trailing_ids(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.id_of(F.col("c_name")).alias("number"))


@query(f"""WITH {RANKING}, {HEALTH.split(CASES + ',', 1)[1]},
b AS (SELECT r.case_id, coalesce(best_score, 0) AS best, coalesce(risk, 0) AS risk, r.status = 'top_performer' OR segment IN ('top_winner', 'strong_candidate') AS good, r.status IN ('underperformer', 'fatigued') OR fatigue_status = 'tired' OR coalesce(best_score, 0) <= 0.35 AS bad FROM ranking r JOIN healthy h USING (case_id))
SELECT * FROM (SELECT 'good' AS kind, case_id, round(0.70 * best + 0.30 * (1 - risk), 6) AS score FROM b WHERE good ORDER BY score DESC, case_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'bad', case_id, round(0.50 * (1 - best) + 0.50 * risk, 6) AS score FROM b WHERE bad ORDER BY score DESC, case_id LIMIT 8)""")
def brief_cases(spark, sf_dir):
    """Without a text hit: the best good cases and the worst bad ones, by blended scores."""
    state = healthy(spark, sf_dir).select("case_id", "risk", "fatigue_status")
    rows = Scratch(spark, "brief").table(ranked(spark, sf_dir).join(state, "case_id"))
    best, risk = F.coalesce("best_score", F.lit(0.0)), F.coalesce("risk", F.lit(0.0))
    good = (F.col("status") == "top_performer") | F.col("segment").isin("top_winner", "strong_candidate")
    bad = F.col("status").isin("underperformer", "fatigued") | (F.col("fatigue_status") == "tired") | (best <= 0.35)
    top = lambda kind, where, score: rows.where(where).select(F.lit(kind).alias("kind"), "case_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "case_id").limit(8)
    return top("good", good, 0.70 * best + 0.30 * (1 - risk)).union(top("bad", bad, 0.50 * (1 - best) + 0.50 * risk))


@query(f"WITH {CASES} SELECT case_id, CAST(date_diff('day', launch_date, DATE '2000-01-01') + 1 AS INT) AS duration_days, size % 3 = 0 AS is_third, length(vertical) AS vertical_length FROM cases WHERE launch_date IS NOT NULL")
def derived_columns(spark, sf_dir):
    rows = cases(spark, sf_dir).where("launch_date IS NOT NULL")
    return rows.select("case_id", (F.datediff(F.lit("2000-01-01").cast("date"), "launch_date") + 1).alias("duration_days"), (F.pmod("size", F.lit(3)) == 0).alias("is_third"), F.length("vertical").cast("long").alias("vertical_length"))


@query("""WITH b AS (SELECT l_orderkey, least(1, greatest(0, l_tax * 10)) AS y, least(1, l_discount * 8) AS x FROM lineitem), r AS (SELECT l_orderkey, floor(y * 20) AS bucket, count(*) AS n FROM b GROUP BY ALL)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS elements, count(*) FILTER (n >= 2) AS full_rows, sum(n) >= 4 AND count(*) FILTER (n >= 2) >= 2 AS grid_like FROM r GROUP BY l_orderkey""")
def shape_rows(spark, sf_dir):
    """Elements in rows of a twentieth of the height; two rows of two or more make a grid."""
    y = clip(F.col("l_tax") * 10, 0, 1)
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.floor(y * 20).alias("bucket")).agg(F.count("*").alias("n"))
    full = F.count(F.when(F.col("n") >= 2, 1))
    return rows.groupBy("l_orderkey").agg(F.sum("n").alias("elements"), full.alias("full_rows"), ((F.sum("n") >= 4) & (full >= 2)).alias("grid_like"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS x1, l_tax * 10 AS y1, l_discount * 8 + 0.2 AS x2, l_tax * 10 + 0.1 AS y2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, x2) - least(1, x1)) * greatest(0, least(1, y2) - least(1, y1)), 6) AS area, CASE WHEN (least(1, y1) + least(1, y2)) / 2 < 1 / 3 THEN 'top' WHEN (least(1, y1) + least(1, y2)) / 2 < 2 / 3 THEN 'middle' ELSE 'bottom' END AS zone FROM t""")
def parsed_boxes(spark, sf_dir):
    """Corner payloads as JSON text, parsed and clamped: quad to box, area, zone."""
    x1, y1 = F.col("l_discount") * 8, F.col("l_tax") * 10
    payload = F.to_json(F.struct(F.array(x1, y1, x1 + 0.2, y1, x1 + 0.2, y1 + 0.1, x1, y1 + 0.1).alias("quad")))
    box = G.clamped(G.quad_to_box(F.from_json(payload, "quad array<double>")["quad"]))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    return rows.select("l_orderkey", "l_linenumber", F.round(G.area(F.col("box")), 6).alias("area"), G.vertical_zone(G.center(F.col("box"))[1]).alias("zone"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def quality_gate(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return read(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in ("part", "orders", "lineitem", "documents")))
def source_report(spark, sf_dir):
    out = None
    for t in ("part", "orders", "lineitem", "documents"):
        one = read(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 4")
def having_counts(spark, sf_dir):
    rows = O.rollup_days(read(spark, sf_dir, "events"))
    return rows.where("fact_rows >= 4").select("user_id", F.col("day").cast("string").alias("day"), F.col("fact_rows").alias("n"))
