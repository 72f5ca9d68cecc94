"""Lists, search, details, blocks and the streamed rollup."""

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import serving as S
from ..sources.scratch import Scratch
from ..streaming import rollup
from . import query, read
from .facts import DAYS, _dated, days
from .ranking import CASES, HEALTH, RANKING, cases, healthy, ranked


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') OR contains(CAST(p_partkey AS VARCHAR), 'brand#1')")
def search_cases(spark, sf_dir):
    return S.search(read(spark, sf_dir, "part"), "Brand#1", ("p_name", "p_brand", "p_type"), "p_partkey").select("p_partkey", "p_name")


@query(f"WITH {RANKING} SELECT case_id, best_score, (SELECT count(*) FROM ranking WHERE lower(format) = 'large') AS total FROM ranking WHERE lower(format) = 'large' ORDER BY best_score DESC NULLS LAST, case_id LIMIT 50 OFFSET 10")
def list_page(spark, sf_dir):
    rows = S.equals_any_case(Scratch(spark, "page").table(ranked(spark, sf_dir)), {"format": "Large", "vertical": ""})
    return S.page(rows, (F.desc_nulls_last("best_score"), F.asc("case_id")), 50, 10).select("case_id", "best_score", "total")


@query(f"WITH {CASES} SELECT DISTINCT format AS option FROM cases WHERE format IS NOT NULL")
def options(spark, sf_dir):
    return S.options(cases(spark, sf_dir), "format")


@query(f"WITH {RANKING}, {HEALTH.split(CASES + ',', 1)[1]} SELECT r.case_id, r.segment, r.hint, h.fatigue_status, h.health_hint FROM ranking r LEFT JOIN healthy h USING (case_id) WHERE r.case_id = 42")
def case_detail(spark, sf_dir):
    h = healthy(spark, sf_dir).select("case_id", "fatigue_status", "health_hint")
    return ranked(spark, sf_dir).where("case_id = 42").select("case_id", "segment", "hint").join(h, "case_id", "left")


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, s.s_name AS supplier, c.c_name AS customer FROM supplier s FULL JOIN customer c ON s_suppkey = c_custkey")
def explanations_outer(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return S.keyed_union({"s": s, "c": c}, "id").select("id", F.col("s.s_name").alias("supplier"), F.col("c.c_name").alias("customer"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'pricey' END) AS sets FROM part WHERE p_size > 40 OR p_retailprice > 1000")
def highlight_sets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return S.highlight({"pricey": p.where("p_retailprice > 1000"), "large": p.where("p_size > 40")}, "p_partkey")


COLUMNS = ["size", "spend", "impressions", "ctr"]
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, m AS median, avg(coalesce({c}, m)) AS center, stddev_pop(coalesce({c}, m)) AS spread FROM cases, (SELECT median({c})::DOUBLE AS m FROM cases) GROUP BY m" for c in COLUMNS)


@query(f"WITH {CASES}, s AS ({_STATS}) SELECT column_name, round(median, 5) AS median, round(center, 5) AS center, round(CASE WHEN spread > 0 THEN spread ELSE 1 END, 5) AS spread FROM s")
def block_fit_stats(spark, sf_dir):
    return B.fit(cases(spark, sf_dir), COLUMNS).select("column_name", *[F.round(c, 5).alias(c) for c in ("median", "center", "spread")])


@query(f"WITH {CASES}, s AS ({_STATS}), z AS (SELECT case_id, {', '.join(f'''(coalesce({c}, (SELECT median FROM s WHERE column_name = '{c}')) - (SELECT center FROM s WHERE column_name = '{c}')) / (SELECT CASE WHEN spread > 0 THEN spread ELSE 1 END FROM s WHERE column_name = '{c}') AS z{i}''' for i, c in enumerate(COLUMNS))} FROM cases) SELECT case_id, {', '.join(f'round(z{i} / sqrt({" + ".join(f"z{j} * z{j}" for j in range(len(COLUMNS)))}), 6) AS b{i}' for i in range(len(COLUMNS)))} FROM z")
def block_transform(spark, sf_dir):
    table = Scratch(spark, "blocks").table(cases(spark, sf_dir))
    out = B.transform(table, B.fit(table, COLUMNS), "case_id", COLUMNS)
    return out.select("case_id", *[F.round(F.col("block")[i], 6).alias(f"b{i}") for i in range(len(COLUMNS))])


@query()
def landscape_pca(spark, sf_dir):
    return B.landscape(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {DAYS} SELECT CAST(day AS VARCHAR) AS day, user_id, impressions, clicks, conversions, revenue FROM days")
def stream_rollup(spark, sf_dir):
    """The stream's plan over the whole table at once; tests run it as a stream."""
    return _dated(rollup.daily_counts(read(spark, sf_dir, "events")))


@query(f"WITH {DAYS} SELECT user_id, CAST(day AS VARCHAR) AS day, impressions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impressions DESC, day) AS n FROM days) WHERE n = 1")
def peak_day(spark, sf_dir):
    from ..operators.facts import keep_first

    return _dated(keep_first(days(spark, sf_dir), ("user_id",), (F.desc("impressions"), F.asc("day")))).select("user_id", "day", "impressions")
