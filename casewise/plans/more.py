"""Rates of rolling sums, label elements, categories, correlations, saved indexes, explanations."""

import itertools

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import facts
from ..operators import retrieval as R
from ..operators import texts as T
from ..operators.fetch import fetch, pack
from ..sources.indexes import load_index, save_index
from ..sources.scratch import Scratch
from . import query, read
from .facts import DAYS, SUMS, _dated, days
from .ranking import CASES, HEALTH, RANKING, cases, healthy, neighbors, ranked
from .retrieval import BLOCKS, CHOSEN, RELAXED, K, candidates_sql, condition, found
from .retrieval import cases as embedded
from .texts import LABEL, LABELS, labels

_RATES = {"ctr": ("clicks", "impressions", 1), "cvr": ("conversions", "clicks", 1), "ipm": ("conversions", "impressions", 1000)}


def _rate_columns() -> str:
    frame = "OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return ", ".join(f"round({m}.0::DOUBLE * coalesce(sum({n}) {frame.format(w=w)}, 0) / nullif(coalesce(sum({d}) {frame.format(w=w)}, 0), 0), 6) AS {r}_prev_{w}d" for w in (3, 7, 14) for r, (n, d, m) in _RATES.items())


@query(f"WITH {DAYS} SELECT user_id, CAST(day AS VARCHAR) AS day, {_rate_columns()} FROM days")
def rolling_rates(spark, sf_dir):
    out = facts.rolling_rates(facts.rolling_previous(days(spark, sf_dir), SUMS))
    return _dated(out).select("user_id", "day", *[f"{r}_prev_{w}d" for w in (3, 7, 14) for r in _RATES])


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(label, '{w}')" for w in words) + ")"


ELEMENTS = f"e AS (SELECT brand AS image, p_partkey, {LABEL.format('text')} AS label, round(area, 9) AS area FROM ({LABELS}))"


def elements(spark, sf_dir):
    """The labels of each image (a brand's parts), in order."""
    one = F.struct("p_partkey", T.normalize_label(F.col("text")).alias("label"), F.round("area", 9).alias("area"))
    return labels(spark, sf_dir).groupBy(F.col("brand").alias("image")).agg(F.array_sort(F.collect_list(one)).alias("elements"))


@query(f"""WITH {ELEMENTS} SELECT image, bool_or({_has(("$", *T.CURRENCIES))} OR {_has(T.PROMO_KEYWORDS)}) AS has_promo, bool_or({_has(T.PROMO_KEYWORDS)}) AS has_discount, bool_or({_has(("$", *T.CURRENCIES))}) AS has_price,
  min(p_partkey) FILTER ({_has(T.CTA_KEYWORDS)}) AS first_cta, min(p_partkey) FILTER ({_has(("nowhere",))}) AS first_nowhere, count(*) AS labels FROM e GROUP BY image""")
def label_flags(spark, sf_dir):
    texts = F.transform("elements", lambda e: e["label"])
    found = {f"first_{n}": T.first_with(F.col("elements"), w)["p_partkey"] for n, w in (("cta", T.CTA_KEYWORDS), ("nowhere", ("nowhere",)))}
    return elements(spark, sf_dir).select("image", *[c.alias(n) for n, c in (T.promo_flags(texts) | found).items()], F.size("elements").cast("long").alias("labels"))


WANTED = "learn more today"


@query(f"""WITH {ELEMENTS}, s AS (SELECT *, CASE WHEN label = '{WANTED}' THEN 4 WHEN contains(label, '{WANTED}') THEN 2.5 WHEN label <> '' AND contains('{WANTED}', label) THEN 2 ELSE 0 END
  + 2 * len(list_intersect(list_distinct(string_split(label, ' ')), ['learn', 'more', 'today']))::DOUBLE / 3 + 0.1 * area AS score FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(score, 9) DESC, p_partkey) AS nth FROM s)
SELECT image, CASE WHEN round(score, 9) >= 1 THEN p_partkey END AS best FROM b WHERE nth = 1""")
def best_label_match(spark, sf_dir):
    return elements(spark, sf_dir).select("image", T.best_match(F.col("elements"), F.lit(WANTED))["p_partkey"].alias("best"))


@query("WITH t AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower(coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' Oferta de viaje' WHEN 1 THEN ' UGC reward' ELSE '' END), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t, CASE WHEN turn % 2 = 0 THEN 'food_delivery' END AS v FROM conversations) SELECT conv_id, turn, trim(concat_ws(' ', t, "
    + ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{v}' END" for k, v in T.EXPANSIONS.items()) + ", replace(v, '_', ' '), v)) AS expanded FROM t")
def expanded_briefs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    brief = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " Oferta de viaje").when(F.col("turn") % 3 == 1, " UGC reward").otherwise(""))
    return c.select("conv_id", "turn", T.expanded_brief(brief, F.when(F.col("turn") % 2 == 0, "food_delivery")).alias("expanded"))


OWN_BLOCKS = {"volume": ["spend", "revenue", "impressions"], "rates": ["ctr", "cvr", "ipm", "roas"]}


@query(f"WITH {CASES} SELECT case_id, round((" + " + ".join(f"({' + '.join(f'({c} IS NULL)::INT' for c in cs)}) / {len(cs)}.0::DOUBLE" for cs in OWN_BLOCKS.values()) + ") / 2, 6) AS missing_row_ratio FROM cases")
def missing_ratio(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", F.round(B.missing_row_ratio(OWN_BLOCKS), 6).alias("missing_row_ratio"))


@query(f"""WITH {CASES}, l AS (SELECT DISTINCT 'format' AS column_name, format AS level FROM cases WHERE size <= 25 UNION SELECT DISTINCT 'campaign_id', coalesce(CAST(campaign_id AS VARCHAR), '__missing__') FROM cases WHERE size <= 25),
k AS (SELECT case_id, column_name, level FROM (SELECT case_id, 'format' AS column_name, coalesce(format, '__missing__') AS level FROM cases UNION ALL SELECT case_id, 'campaign_id', coalesce(CAST(campaign_id AS VARCHAR), '__missing__') FROM cases) JOIN l USING (column_name, level))
SELECT case_id, column_name, level, round(1 / sqrt(count(*) OVER (PARTITION BY case_id)), 6) AS weight FROM k""")
def category_block(spark, sf_dir):
    """Levels are fitted on the cases up to size 25, all cases are transformed: larger ones bring unknown levels."""
    table = Scratch(spark, "levels").table(cases(spark, sf_dir))
    columns = ["format", "campaign_id"]
    return B.one_hot(table, B.fit_levels(table.where("size <= 25"), columns), "case_id", columns)


_NUMBERS = ("spend", "impressions", "ctr", "roas", "perf_score")
_PAIRS = list(itertools.combinations(_NUMBERS, 2))


@query(f"WITH {CASES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson FROM cases" for a, b in _PAIRS))
def pearson_matrix(spark, sf_dir):
    """The upper triangle of the correlation matrix, in one aggregate."""
    entry = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))), 6).alias("pearson"))
    return cases(spark, sf_dir).agg(F.array(*[entry(a, b) for a, b in _PAIRS]).alias("all")).select(F.explode("all").alias("p")).select("p.*")


@query("""SELECT 'cases' AS key, CAST((SELECT count(*) FROM part) AS VARCHAR) AS value UNION ALL SELECT 'facts', CAST((SELECT count(*) FROM lineitem) AS VARCHAR)
UNION ALL SELECT 'verticals', (SELECT '["' || string_agg(v, '","' ORDER BY v) || '"]' FROM (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL))""")
def memory_metadata(spark, sf_dir):
    """Key and value rows of scalar counts and JSON lists."""
    part = read(spark, sf_dir, "part")
    counts = {"cases": part.select(F.count("*").cast("string")), "facts": read(spark, sf_dir, "lineitem").select(F.count("*").cast("string")), "verticals": part.select(F.to_json(F.array_sort(F.collect_set("p_brand"))))}
    out = None
    for key, value in counts.items():
        one = value.toDF("value").select(F.lit(key).alias("key"), "value")
        out = one if out is None else out.union(one)
    return out


@query("SELECT s_suppkey, s.s_name, n.n_name, n.n_regionkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def merged_without_overlap(spark, sf_dir):
    """A summary merges without the columns that both sides have, its key aside."""
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nationkey"))
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name", "n_regionkey", F.lit("other").alias("s_name"))
    own = [c for c in nations.columns if c == "nationkey" or c not in suppliers.columns]
    return suppliers.join(nations.select(*own), "nationkey", "left").drop("nationkey")


@query(f"WITH {candidates_sql(*BLOCKS.values())}, {CHOSEN} SELECT query_id, case_id, neighbor, round(similarity, 6) AS similarity FROM chosen")
def saved_index_retrieval(spark, sf_dir):
    """Retrieval from an index that was saved and read again, with the weights of its manifest."""
    path = Scratch(spark, "index").path("cases")
    every = embedded(spark, sf_dir)
    save_index(every.withColumn("vector", R.weighted_vector([(F.col("a"), BLOCKS["block_a"]), (F.col("b"), BLOCKS["block_b"])])), path, BLOCKS)
    index, manifest = load_index(spark, path)
    weights, scratch = {b.removeprefix("block_"): w for b, w in manifest["weights"].items()}, Scratch(spark, "index")
    packed = pack(index, tuple(weights), RELAXED, scratch)
    near = fetch(packed, packed[0], weights, R.overfetch(manifest["cases"], K) - 1, RELAXED, scratch)
    joined = found(spark, near, index, index, manifest["weights"])
    return R.filtered(joined, condition(), K).select("query_id", "case_id", "neighbor", F.round("similarity", 6).alias("similarity"))


SUMMARY = """summary AS (SELECT query_id, count(*) AS similar_case_count, round(avg(similarity), 4) AS avg_similarity, round(max(similarity), 4) AS max_similarity, count(*) FILTER (c_status = 'top_performer') AS top_performer_count, count(*) FILTER (c_status = 'stable') AS stable_count,
  count(*) FILTER (c_status = 'fatigued') AS fatigued_count, round(count(*) FILTER (c_status = 'top_performer') / count(*), 4) AS top_performer_ratio, round(count(*) FILTER (c_status = 'fatigued') / count(*), 4) AS fatigued_ratio, round(median(k.perf_score) + 1e-9, 4) AS median_perf, round(median(k.roas) + 1e-9, 4) AS median_roas, round(median(k.ipm) + 1e-9, 4) AS median_ipm
  FROM neighbors n JOIN cases k ON n.case_id = k.case_id WHERE neighbor <= 10 GROUP BY query_id)"""
_SUMMARY = ["similar_case_count", "avg_similarity", "max_similarity", "top_performer_count", "stable_count", "fatigued_count", "top_performer_ratio", "fatigued_ratio", "median_perf", "median_roas", "median_ipm"]
_FACTS = ["perf_score", "roas", "ipm", "ctr", "cvr", "spend"]


@query(f"WITH {RANKING}, {HEALTH.split(CASES + ',', 1)[1]}, {SUMMARY} SELECT r.case_id, 'winner_explanation' AS answer_type, segment, hint, round(best_score + 1e-9, 4) AS best_score, CASE WHEN best_score IS NOT NULL THEN rank() OVER (ORDER BY best_score DESC NULLS LAST) END AS global_rank, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in _FACTS)}, impressions, coalesce(similar_case_count, 0) AS similar_case_count, {', '.join(_SUMMARY[1:])} FROM ranking r LEFT JOIN summary ON r.case_id = query_id")
def winner_explanations(spark, sf_dir):
    """Evidence for each ranked case, with a summary of its ten most similar cases of the same vertical."""
    from ..operators.order import Rank, with_ranks

    base = Scratch(spark, "explained").table(cases(spark, sf_dir))
    near = neighbors(spark, sf_dir, base).where("neighbor <= 10").join(base.select(F.col("case_id"), F.col("perf_score").alias("c_perf"), F.col("roas").alias("c_roas"), F.col("ipm").alias("c_ipm")), "case_id")
    summary = R.neighbor_summary(near).withColumnRenamed("query_id", "case_id")
    out = with_ranks(Scratch(spark, "explained").table(ranked(spark, sf_dir)), Rank("best_score", descending="global_rank")).join(summary, "case_id", "left")
    return out.select("case_id", F.lit("winner_explanation").alias("answer_type"), "segment", "hint", F.round(F.col("best_score") + 1e-9, 4).alias("best_score"), "global_rank", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in _FACTS], "impressions", F.coalesce("similar_case_count", F.lit(0)).alias("similar_case_count"), *_SUMMARY[1:])


_TIRED = ["tired_score", "repetition_score", "fatigue_day", "ctr_decay", "cvr_decay", "avg_top10_similarity", "same_metadata_ratio", "fatigued_neighbor_ratio"]


@query(f"WITH {HEALTH} SELECT case_id, 'fatigue_repetition_explanation' AS answer_type, fatigue_status, repetition_status, health_hint, has_fatigue, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in _TIRED)} FROM healthy")
def health_explanations(spark, sf_dir):
    """Evidence for each case's health."""
    return healthy(spark, sf_dir).select("case_id", F.lit("fatigue_repetition_explanation").alias("answer_type"), "fatigue_status", "repetition_status", "health_hint", "has_fatigue", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in _TIRED])
