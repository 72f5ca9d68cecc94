"""Cases from part and lineitem, their ranking, health and next tests."""

from pyspark.sql import functions as F

from ..functions.expr import micros, rounded, safe_div
from ..operators import health, knn, nexttest
from ..operators import ranking as R
from ..operators.order import quantiles
from ..sources.scratch import Scratch
from . import query, read

GROUPS = {"vertical": ("vertical",), "format": ("format",), "pair": ("vertical", "format")}
METRICS = ("perf_score", "roas", "ctr")


def cases(spark, sf_dir):
    """One case for each part: its attributes and KPIs summed from lineitem."""
    li = read(spark, sf_dir, "lineitem")
    amount = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity").cast("long")).otherwise(0))
    kpis = li.groupBy("l_partkey").agg(
        (F.sum(micros(F.col("l_extendedprice") * (1 - F.col("l_discount")))) / 10000).alias("spend"),
        (F.sum(micros(F.col("l_extendedprice"))) / 10000).alias("revenue"),
        F.sum(F.col("l_quantity").cast("long")).alias("impressions"),
        amount("R").alias("clicks"),
        amount("A").alias("conversions"),
        F.min("l_suppkey").alias("campaign_id"),
        F.to_date(F.min("l_shipdate")).alias("launch_date"),
    )
    out = read(spark, sf_dir, "part").join(kpis, F.col("p_partkey") == F.col("l_partkey"), "left")
    status = F.when(F.pmod("p_size", F.lit(5)) == 0, "top_performer").when(F.pmod("p_size", F.lit(5)) == 1, "fatigued").when(F.pmod("p_size", F.lit(5)) == 2, "underperformer").otherwise("stable")
    return out.select(
        F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("vertical"), F.col("p_type").alias("format"), F.col("p_size").alias("size"), "campaign_id", "launch_date",
        "spend", "revenue", "impressions", "clicks", "conversions", status.alias("status"),
        rounded(safe_div(F.col("revenue"), F.col("spend")), 6).alias("roas"),
        rounded(safe_div(F.col("conversions") * 1000, F.col("impressions")), 6).alias("ipm"),
        rounded(safe_div(F.col("conversions"), F.col("clicks")), 6).alias("cvr"),
        rounded(safe_div(F.col("clicks"), F.col("impressions")), 6).alias("ctr"),
        rounded(F.col("p_retailprice") / 1000, 6).alias("perf_score"),
    )


CASES = """
kpis AS (
  SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS BIGINT) / 10000 AS spend,
    CAST(sum(CAST(round(l_extendedprice * 10000) AS BIGINT)) AS BIGINT) / 10000 AS revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS clicks,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS conversions,
    min(l_suppkey) AS campaign_id, CAST(min(l_shipdate) AS DATE) AS launch_date
  FROM lineitem GROUP BY l_partkey),
cases AS (
  SELECT p_partkey AS case_id, p_brand AS vertical, p_type AS format, p_size AS size, campaign_id, launch_date, spend, revenue, impressions, clicks, conversions,
    CASE p_size % 5 WHEN 0 THEN 'top_performer' WHEN 1 THEN 'fatigued' WHEN 2 THEN 'underperformer' ELSE 'stable' END AS status,
    round(revenue / nullif(spend, 0), 6) AS roas, round(conversions * 1000.0::DOUBLE / nullif(impressions, 0), 6) AS ipm,
    round(conversions::DOUBLE / nullif(clicks, 0), 6) AS cvr, round(clicks::DOUBLE / nullif(impressions, 0), 6) AS ctr, round(p_retailprice / 1000, 6) AS perf_score
  FROM part LEFT JOIN kpis ON p_partkey = l_partkey)"""


def _pct(value: str, by: str = "", name: str | None = None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {value}) + (count({value}) OVER ({tie}) - 1) / 2.0::DOUBLE) / count({value}) OVER ({part}) END AS {name or value + '_pct'}"


RANKING = f"""{CASES},
marked AS (
  SELECT c.*, coalesce(spend >= (SELECT quantile_cont(spend, 0.25) FROM cases) OR impressions >= (SELECT quantile_cont(impressions, 0.25) FROM cases), false) AS has_evidence FROM cases c),
masked AS (SELECT m.*, {", ".join(f"CASE WHEN has_evidence THEN {m} END AS e_{m}" for m in R.WEIGHTS)} FROM marked m),
ranked AS (SELECT * EXCLUDE ({", ".join(f"e_{m}" for m in R.WEIGHTS)}), {", ".join(_pct(f"e_{m}", name=f"{m}_pct") for m in R.WEIGHTS)} FROM masked),
scored AS (
  SELECT r.*, CASE WHEN has_evidence THEN round({" + ".join(f"coalesce({m}_pct, 0) * {w}::DOUBLE" for m, w in R.WEIGHTS.items())} + CASE WHEN status = 'top_performer' THEN 0.03::DOUBLE ELSE 0 END, 6) END AS best_score FROM ranked r),
segmented AS (
  SELECT s.*, CASE WHEN NOT has_evidence THEN 'low_evidence' WHEN top AND status = 'fatigued' THEN 'strong_but_fatigued' WHEN top AND status = 'top_performer' THEN 'top_winner' WHEN top THEN 'strong_candidate' ELSE 'not_top' END AS segment
  FROM (SELECT s.*, best_score >= (SELECT round(quantile_cont(best_score, 0.9), 6) FROM scored) AS top FROM scored s) s),
ranking AS (
  SELECT * EXCLUDE (top), CASE segment WHEN 'low_evidence' THEN 'Gather more data' WHEN 'strong_but_fatigued' THEN 'Refresh' WHEN 'top_winner' THEN 'Scale' WHEN 'strong_candidate' THEN 'Keep' ELSE 'Review' END AS hint
  FROM segmented)"""


def ranked(spark, sf_dir):
    return R.winner_ranking(cases(spark, sf_dir))


RANK_COLUMNS = ["case_id", "vertical", "format", "status", "has_evidence", *[f"{m}_pct" for m in R.WEIGHTS], "best_score", "segment", "hint"]


def _rounded(names) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" if c.endswith("_pct") else c for c in names)


def _round_pct(df, names):
    return df.select(*[rounded(F.col(c), 9).alias(c) if c.endswith("_pct") else F.col(c) for c in names])


@query(f"WITH {RANKING} SELECT {_rounded(RANK_COLUMNS)} FROM ranking")
def winner_ranking(spark, sf_dir):
    return _round_pct(ranked(spark, sf_dir), RANK_COLUMNS)


@query(f"WITH {RANKING} SELECT case_id, best_score, segment FROM ranking WHERE has_evidence ORDER BY best_score DESC NULLS LAST, case_id LIMIT 20")
def winner_top_global(spark, sf_dir):
    return ranked(spark, sf_dir).where("has_evidence").orderBy(F.desc_nulls_last("best_score"), "case_id").limit(20).select("case_id", "best_score", "segment")


@query(f"WITH {RANKING}, t AS (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY best_score DESC, case_id) AS place FROM ranking WHERE has_evidence) SELECT vertical, CAST(place AS INT) AS place, case_id, best_score FROM t WHERE place <= 10")
def winner_top_by_group(spark, sf_dir):
    return R.top_by_group(ranked(spark, sf_dir), ("vertical",), 10).select("vertical", "place", "case_id", "best_score")


@query(f"""WITH {RANKING} SELECT case_id, {", ".join(f"CASE WHEN best_score IS NOT NULL THEN rank() OVER (PARTITION BY {', '.join(by)} ORDER BY best_score DESC NULLS LAST) END AS {n}_rank, CASE WHEN best_score IS NOT NULL THEN count(best_score) OVER (PARTITION BY {', '.join(by)}) END AS {n}_size, round({_pct('best_score', ', '.join(by), 'x').rsplit(' AS ', 1)[0]}, 9) AS {n}_pct" for n, by in GROUPS.items())} FROM ranking""")
def winner_group_ranks(spark, sf_dir):
    out = R.add_group_ranks(ranked(spark, sf_dir), GROUPS)
    return _round_pct(out, ["case_id", *[f"{n}_{k}" for n in GROUPS for k in ("rank", "size", "pct")]])


@query(f"WITH {RANKING} SELECT segment, hint, count(*) AS n, round(avg(best_score), 6) AS mean_score FROM ranking GROUP BY segment, hint")
def winner_segment_counts(spark, sf_dir):
    return ranked(spark, sf_dir).groupBy("segment", "hint").agg(F.count("*").alias("n"), rounded(F.avg("best_score"), 6).alias("mean_score"))


def _benchmark_sql() -> str:
    joins, columns = "", ["case_id"]
    for name, by in (("vertical", ("vertical",)), ("format", ("format",))):
        joins += f" LEFT JOIN (SELECT {', '.join(by)}, {', '.join(f'median({m}) AS {name}_{m}_median' for m in METRICS)} FROM ranking GROUP BY {', '.join(by)}) USING ({', '.join(by)})"
        for m in METRICS:
            columns += [f"round({name}_{m}_median, 7) AS {name}_{m}_median", f"round({m} - {name}_{m}_median, 7) AS {name}_{m}_delta", f"{m} - {name}_{m}_median > 0 AS {name}_{m}_above"]
    return f"WITH {RANKING} SELECT {', '.join(columns)} FROM ranking{joins}"


@query(_benchmark_sql())
def contextual_benchmarks(spark, sf_dir):
    groups = {k: GROUPS[k] for k in ("vertical", "format")}
    out = R.contextual_benchmarks(Scratch(spark, "benchmarks").table(ranked(spark, sf_dir)), METRICS, groups)
    named = [(f"{g}_{m}_{k}", k) for g in groups for m in METRICS for k in ("median", "delta", "above")]
    return out.select("case_id", *[F.col(n) if k == "above" else F.round(n, 7).alias(n) for n, k in named])


@query(f"WITH {CASES} SELECT vertical, round(quantile_cont(spend, 0.25), 4) AS p25, round(quantile_cont(spend, 0.5), 4) AS p50, round(quantile_cont(spend, 0.9), 4) AS p90, round(quantile_cont(spend, 0.95), 4) AS p95 FROM cases GROUP BY vertical HAVING count(spend) > 0")
def quantile_profile(spark, sf_dir):
    out = quantiles(cases(spark, sf_dir), "spend", {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p95": 0.95}, ("vertical",))
    return out.select("vertical", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p90", "p95")])


HEALTH = f"""{CASES},
aged AS (
  SELECT c.*, status = 'fatigued' AS has_fatigue, round(ctr - 0.35, 6) AS ctr_decay, round(cvr - 1, 6) AS cvr_decay,
    CASE WHEN status = 'fatigued' THEN size + 1 END AS fatigue_day FROM cases c),
severity AS (
  SELECT a.*, CASE WHEN has_fatigue THEN 1.0::DOUBLE ELSE 0 END AS label_score,
    CASE WHEN cq > 0 THEN least(1, greatest(0, coalesce(-ctr_decay, 0)) / cq) ELSE 0 END AS ctr_severity,
    CASE WHEN vq > 0 THEN least(1, greatest(0, coalesce(-cvr_decay, 0)) / vq) ELSE 0 END AS cvr_severity,
    CASE WHEN dq > 0 AND fatigue_day IS NOT NULL THEN greatest(0, least(1, 1 - fatigue_day / dq)) ELSE 0 END AS early_severity
  FROM aged a, (SELECT quantile_cont(greatest(0, coalesce(-ctr_decay, 0)), 0.95) AS cq, quantile_cont(greatest(0, coalesce(-cvr_decay, 0)), 0.95) AS vq, quantile_cont(fatigue_day, 0.95) AS dq FROM aged)),
tired AS (SELECT s.*, round(0.35 * label_score + 0.25 * ctr_severity + 0.20 * cvr_severity + 0.20 * early_severity, 6) AS tired_score FROM severity s),
near AS (
  SELECT q.case_id AS query_id, c.case_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS similarity,
    q.format IS NOT DISTINCT FROM c.format AS same_format, q.size IS NOT DISTINCT FROM c.size AS same_size, c.status AS c_status
  FROM embeddings a JOIN cases q ON a.vec_id = q.case_id JOIN cases c ON q.vertical = c.vertical AND q.case_id <> c.case_id JOIN embeddings b ON b.vec_id = c.case_id),
neighbors AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS neighbor FROM near) WHERE neighbor <= 20),
rep AS (
  SELECT query_id, count(*) AS similar_cases, round(avg(similarity) FILTER (neighbor <= 5), 4) AS avg_top5_similarity, round(avg(similarity) FILTER (neighbor <= 10), 4) AS avg_top10_similarity, round(max(similarity), 4) AS max_similarity,
    count(*) FILTER (similarity >= 0.3) AS dense_neighbors, round((avg(same_format::INT) FILTER (neighbor <= 10) + avg(same_size::INT) FILTER (neighbor <= 10)) / 2, 4) AS same_metadata_ratio,
    round(avg((c_status = 'fatigued')::INT) FILTER (neighbor <= 10), 4) AS fatigued_neighbor_ratio FROM neighbors GROUP BY query_id),
filled AS (
  SELECT t.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in health.REPETITION)} FROM tired t LEFT JOIN rep ON case_id = query_id),
repeated AS (SELECT f.*, {_pct("avg_top10_similarity", name="mean_pct")}, {_pct("dense_neighbors", name="dense_pct")} FROM filled f),
scored_health AS (SELECT r.*, round(least(1, greatest(0, 0.5 * mean_pct + 0.25 * same_metadata_ratio + 0.25 * dense_pct)) + 1e-9, 6) AS repetition_score FROM repeated r),
health AS (
  SELECT r.*, CASE WHEN tired_score >= 0.65 THEN 'tired' WHEN tired_score >= 0.40 THEN 'at_risk' ELSE 'healthy' END AS fatigue_status,
    CASE WHEN repetition_score >= 0.75 THEN 'high_repetition' WHEN repetition_score >= 0.55 THEN 'moderate_repetition' ELSE 'distinct' END AS repetition_status
  FROM scored_health r),
healthy AS (
  SELECT h.*, greatest(tired_score, repetition_score) AS risk,
    CASE WHEN fatigue_status = 'tired' OR repetition_status = 'high_repetition' THEN 'Refresh' WHEN fatigue_status = 'at_risk' OR repetition_status = 'moderate_repetition' THEN 'Monitor' ELSE 'Keep' END AS health_hint
  FROM health h)"""


def neighbors(spark, sf_dir, base):
    """Up to twenty most similar cases of the same vertical, where a case has an embedding."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    known = vectors.join(base.select(F.col("case_id").alias("id"), "vertical"), "id")
    near = Scratch(spark, "neighbors").table(knn.nearest(known, known, 20, group_col="vertical"))
    side = lambda p, key: base.select(F.col("case_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("format", "size", "status")])
    return near.join(side("q", "query_id"), "query_id").join(side("c", "case_id"), "case_id")


def healthy(spark, sf_dir, base=None, near=None):
    base = Scratch(spark, "cases").table(cases(spark, sf_dir)) if base is None else base
    aged = base.withColumns({
        "has_fatigue": F.col("status") == "fatigued",
        "ctr_decay": F.round(F.col("ctr") - 0.35, 6),
        "cvr_decay": F.round(F.col("cvr") - 1, 6),
        "fatigue_day": F.when(F.col("status") == "fatigued", F.col("size") + 1),
    })
    near = neighbors(spark, sf_dir, base) if near is None else near
    return health.with_status(health.repetition_scores(health.tired_scores(aged), health.repetition(near, ("format", "size"), 0.3), "case_id"))


@query(f"WITH {HEALTH} SELECT case_id, {', '.join(health.REPETITION)}, repetition_score FROM healthy")
def repetition_scores(spark, sf_dir):
    return healthy(spark, sf_dir).select("case_id", *health.REPETITION, "repetition_score")


HEALTH_COLUMNS = ["case_id", "tired_score", "repetition_score", "fatigue_status", "repetition_status", "risk", "health_hint"]


@query(f"WITH {HEALTH} SELECT {', '.join(HEALTH_COLUMNS)} FROM healthy")
def health_scores(spark, sf_dir):
    return healthy(spark, sf_dir).select(*HEALTH_COLUMNS)


@query(f"WITH {HEALTH} SELECT fatigue_status, repetition_status, health_hint, count(*) AS n FROM healthy GROUP BY ALL")
def health_summary(spark, sf_dir):
    return healthy(spark, sf_dir).groupBy("fatigue_status", "repetition_status", "health_hint").agg(F.count("*").alias("n"))


@query(f"WITH {HEALTH} PIVOT (SELECT fatigue_status, repetition_status FROM healthy) ON repetition_status IN ('high_repetition', 'moderate_repetition', 'distinct') USING count(*) GROUP BY fatigue_status")
def status_crosstab(spark, sf_dir):
    return healthy(spark, sf_dir).groupBy("fatigue_status").pivot("repetition_status", ["high_repetition", "moderate_repetition", "distinct"]).count().na.fill(0)


@query(f"WITH {HEALTH} SELECT case_id, tired_score FROM healthy WHERE fatigue_status IN ('tired', 'at_risk') ORDER BY fatigue_status DESC, tired_score DESC, case_id LIMIT 100")
def health_tired_top(spark, sf_dir):
    return healthy(spark, sf_dir).where(F.col("fatigue_status").isin("tired", "at_risk")).orderBy(F.desc("fatigue_status"), F.desc("tired_score"), "case_id").limit(100).select("case_id", "tired_score")


TRAITS, NUMBERS = ("format", "campaign_id"), {"size": "size", "ctr": "click-through rate", "cvr": "conversion rate"}


def _facts(by: str) -> str:
    """Facts of winners (w_ columns) by a key."""
    modes = ", ".join(f"arg_min(w_{c}, o_{c}) AS mode_{c}, max(n_{c}) / count(*) AS share_{c}" for c in TRAITS)
    counts = ", ".join(f"CASE WHEN w_{c} IS NOT NULL THEN count(*) OVER (PARTITION BY {by}, w_{c}) END AS n_{c}" for c in TRAITS)
    order = ", ".join(f"row_number() OVER (PARTITION BY {by} ORDER BY n_{c} DESC NULLS LAST, w_{c}) AS o_{c}" for c in TRAITS)
    return f"SELECT {by}, count(*) AS winners, {modes}, {', '.join(f'median(w_{c}) AS median_{c}' for c in NUMBERS)} FROM (SELECT *, {order} FROM (SELECT *, {counts} FROM {{0}})) GROUP BY {by}"


W = ", ".join(f"w.{c} AS w_{c}" for c in (*TRAITS, *NUMBERS))
TESTS = ", ".join([f"CASE WHEN share_{c} >= 0.35 AND CAST(mode_{c} AS VARCHAR) <> coalesce(CAST(r.{c} AS VARCHAR), 'nan') THEN 'test {c}=''' || mode_{c} || '''' END" for c in TRAITS] + [
    f"CASE WHEN std_{c} > 0 AND abs(median_{c} - r.{c}) >= 0.35 * std_{c} THEN CASE WHEN median_{c} > r.{c} THEN 'increase' ELSE 'reduce' END || ' {label}' END" for c, label in NUMBERS.items()])
NEXT = f"""{RANKING}, {HEALTH.split(CASES + ",", 1)[1]},
top AS (SELECT case_id, vertical, format, best_score FROM ranking WHERE status = 'top_performer'),
long AS (SELECT case_id, best_score, 'both' AS kind, concat_ws('|', vertical, format) AS key FROM top UNION ALL SELECT case_id, best_score, 'vertical', vertical FROM top UNION ALL SELECT case_id, best_score, 'format', format FROM top UNION ALL SELECT case_id, best_score, 'any', 'any' FROM top),
members AS (SELECT kind, key, case_id AS winner_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY best_score DESC NULLS LAST, case_id) AS place FROM long) WHERE place <= 20),
counts AS (SELECT kind, key, count(*) AS n FROM long GROUP BY ALL),
contexts AS (
  SELECT vertical, format, CASE WHEN v.n >= 3 THEN CASE WHEN b.n >= 3 THEN 'both' ELSE 'vertical' END WHEN f.n >= 3 THEN 'format' ELSE 'any' END AS kind
  FROM (SELECT DISTINCT vertical, format FROM ranking) d LEFT JOIN counts v ON v.kind = 'vertical' AND v.key = vertical LEFT JOIN counts b ON b.kind = 'both' AND b.key = concat_ws('|', vertical, format) LEFT JOIN counts f ON f.kind = 'format' AND f.key = format),
keyed AS (SELECT *, CASE kind WHEN 'both' THEN concat_ws('|', vertical, format) WHEN 'vertical' THEN vertical WHEN 'format' THEN format ELSE 'any' END AS key FROM contexts),
own_rows AS (SELECT query_id, {W} FROM neighbors JOIN ranking w USING (case_id) WHERE w.status = 'top_performer'), own AS ({_facts("query_id").format("own_rows")}),
pool_rows AS (SELECT kind || ':' || key AS pool, {W} FROM members JOIN ranking w ON winner_id = w.case_id), pools AS ({_facts("pool").format("pool_rows")}),
seen AS (SELECT query_id, count(*) AS similar_cases, count(*) FILTER (c_status = 'top_performer') AS similar_top, count(*) FILTER (c_status = 'fatigued') AS similar_fatigued, round(avg(similarity), 6) AS avg_similarity FROM neighbors GROUP BY query_id),
facts AS (
  SELECT r.case_id, coalesce(o.winners, 0) >= 3 AS by_neighbors, {", ".join(f"CASE WHEN o.winners >= 3 THEN o.{c} ELSE p.{c} END AS {c}" for c in ("winners", *[f"{k}_{t}" for t in TRAITS for k in ("mode", "share")], *[f"median_{n}" for n in NUMBERS]))}
  FROM ranking r LEFT JOIN own o ON r.case_id = o.query_id LEFT JOIN keyed k ON r.vertical = k.vertical AND r.format = k.format LEFT JOIN pools p ON p.pool = k.kind || ':' || k.key),
suggested AS (
  SELECT r.case_id, best_score, segment, coalesce(winners, 0) AS winners, by_neighbors, risk, fatigue_status, repetition_status, coalesce(s.similar_cases, 0) AS similar_cases, coalesce(similar_top, 0) AS similar_top, coalesce(similar_fatigued, 0) AS similar_fatigued, avg_similarity,
    [x FOR x IN [{TESTS}] IF x IS NOT NULL][1:5] AS found
  FROM ranking r JOIN (SELECT case_id, risk, fatigue_status, repetition_status FROM healthy) h USING (case_id) JOIN facts USING (case_id) LEFT JOIN seen s ON r.case_id = s.query_id, (SELECT {", ".join(f"stddev_samp({c}) AS std_{c}" for c in NUMBERS)} FROM cases)),
decided AS (
  SELECT *, CASE WHEN winners = 0 THEN ['{nexttest.NO_WINNERS}'] WHEN len(found) = 0 THEN ['{nexttest.NO_DIFFERENCE}'] ELSE found END AS tests,
    CASE WHEN segment = 'low_evidence' THEN 'Gather evidence' WHEN fatigue_status = 'tired' OR repetition_status = 'high_repetition' THEN 'Refresh' WHEN segment = 'top_winner' THEN 'Scale' WHEN segment = 'strong_candidate' THEN 'Keep'
      WHEN best_score < 0.35 THEN 'Pause or rebuild' ELSE 'Test next variation' END AS action FROM suggested)"""


@query(f"""WITH {NEXT}
SELECT case_id, winners, by_neighbors, similar_cases, similar_top, similar_fatigued, avg_similarity, action, tests[1] AS suggestion_1, tests[2] AS suggestion_2, tests[3] AS suggestion_3,
  CASE action WHEN 'Gather evidence' THEN '{nexttest.GATHER}' {" ".join(f"WHEN '{a}' THEN '{t}' || array_to_string(tests[1:{n}], '; ')" for a, (t, n) in nexttest.OPENINGS.items())} END AS next_test,
  round(CASE WHEN segment IN ('top_winner', 'strong_candidate') THEN 0.40 + 0.60 * risk ELSE 0.60 * coalesce(1 - best_score, 0.5) + 0.40 * risk END + 1e-9, 4) AS priority
FROM decided""")  # fmt: skip
def next_tests(spark, sf_dir):
    scratch = Scratch(spark, "next")
    base = scratch.table(cases(spark, sf_dir))
    ranking = scratch.table(R.winner_ranking(base))
    near = scratch.table(neighbors(spark, sf_dir, base))
    state = healthy(spark, sf_dir, base, near).select("case_id", "risk", "fatigue_status", "repetition_status")
    traits = ranking.select(F.col("case_id").alias("winner_id"), F.col("status").alias("w_status"), *[F.col(c).alias(f"w_{c}") for c in (*TRAITS, *NUMBERS)])
    own = near.select("query_id", F.col("case_id").alias("winner_id")).join(traits.where("w_status = 'top_performer'"), "winner_id")
    own = nexttest.winner_facts(own, ("query_id",), TRAITS, tuple(NUMBERS)).where(F.col("winners") >= nexttest.ENOUGH)
    contexts, members = nexttest.fallback_pools(ranking)
    pools = nexttest.winner_facts(members.join(traits, "winner_id"), ("kind", "key"), TRAITS, tuple(NUMBERS))
    names = [c for c in own.columns if c != "query_id"]
    spread = base.agg(*[F.stddev_samp(c).alias(f"std_{c}") for c in NUMBERS])
    seen = near.groupBy("query_id").agg(F.count("*").alias("similar_cases"), F.count(F.when(F.col("c_status") == "top_performer", 1)).alias("similar_top"), F.count(F.when(F.col("c_status") == "fatigued", 1)).alias("similar_fatigued"), F.round(F.avg("similarity"), 6).alias("avg_similarity"))
    out = ranking.join(state, "case_id").join(own.select(F.col("query_id").alias("case_id"), *[F.col(c).alias(f"own_{c}") for c in names]), "case_id", "left").join(seen.withColumnRenamed("query_id", "case_id"), "case_id", "left")
    out = out.join(contexts, ["vertical", "format"], "left").join(pools, ["kind", "key"], "left").crossJoin(F.broadcast(spread))  # one row
    out = out.withColumn("by_neighbors", F.col("own_winners").isNotNull())
    out = out.withColumns({c: F.when(F.col("by_neighbors"), F.col(f"own_{c}")).otherwise(F.col(c)) for c in names})
    out = out.withColumn("tests", nexttest.suggestions(TRAITS, NUMBERS)).withColumn("action", nexttest.action())
    return out.select(
        "case_id", F.coalesce("winners", F.lit(0)).alias("winners"), "by_neighbors", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("similar_cases", "similar_top", "similar_fatigued")], "avg_similarity", "action",
        *[F.get("tests", k).alias(f"suggestion_{k + 1}") for k in range(3)], nexttest.composed(F.col("action"), F.col("tests")).alias("next_test"), nexttest.priority().alias("priority"),
    )
