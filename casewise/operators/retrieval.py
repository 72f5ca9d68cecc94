"""Filtered retrieval, relaxation, re-scoring, reasons, reuse and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import agreement, cases_of, clip, norm, safe_div, same_known, weighted_mean

#: Shares of the final score, codes of the image blocks, statuses that count as tired.
SCORING = {"global": 0.70, "agreement": 0.15, "context": 0.10, "quality": 0.05}
BLOCK_CODES = {"clip": "HIGH_CLIP_SIMILARITY", "cnn": "HIGH_CNN_SIMILARITY"}
FATIGUED = ("fatigued", "fatigue")


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    """Positive weights, scaled to sum 1."""
    used = {k: w for k, w in weights.items() if w > 0}
    return {k: w / sum(used.values()) for k, w in used.items()}


def resolved_filters(defaults: dict, exclude_same_campaign: bool, call: dict | None = None) -> dict:
    """Configured filters, the default for cases of the same campaign over them, a call's own over both."""
    return defaults | {"exclude_same_campaign": exclude_same_campaign} | (call or {})


def neighbor_summary(neighbors: DataFrame) -> DataFrame:
    """For each query: how many neighbours, how alike, their statuses and median outcomes (c_status, c_perf, c_roas, c_ipm)."""
    status = lambda s: F.count(F.when(F.col("c_status") == s, 1))
    four = lambda x, name: F.round(x, 4).alias(name)
    return neighbors.groupBy("query_id").agg(
        F.count("*").alias("similar_case_count"), four(F.avg("similarity"), "avg_similarity"), four(F.max("similarity"), "max_similarity"),
        *[status(s).alias(f"{n}_count") for n, s in (("top_performer", "top_performer"), ("stable", "stable"), ("fatigued", "fatigued"))],
        four(status("top_performer") / F.count("*"), "top_performer_ratio"), four(status("fatigued") / F.count("*"), "fatigued_ratio"),
        *[four(F.median(f"c_{c}") + 1e-9, f"median_{c}") for c in ("perf", "roas", "ipm")],  # halves go up, however they are stored
    )


def overfetch(n: int, k: int) -> int:
    """How many of n indexed cases are fetched before filters; the query itself is one of them."""
    return min(n, max(10 * k, k + 1, 20))


def weighted_vector(blocks: list[tuple[Column, float]]) -> Column:
    """Blocks at unit length times the roots of their weights, end to end: inner products are weighted sums of the blocks' cosines."""

    def part(v: Column, w: float) -> Column:
        return F.transform(v, lambda x: x.cast("double") / norm(v) * w**0.5)

    return F.concat(*[part(v, w) for v, w in blocks])


def passes(same: tuple[str, ...] = (), other: tuple[str, ...] = (), at_least: dict[tuple[str, ...], float] | None = None) -> Column:
    """Filters between q_<column> of the query and c_<column> of the case.

    same: equal to a present query value; other: different from it. at_least: the greatest of
    the case's columns reaches a number; a case with none of them present passes.
    """
    out = F.lit(True)
    for c in same:
        out = out & F.when(F.col(f"q_{c}").isNull(), True).otherwise(F.coalesce(F.col(f"q_{c}") == F.col(f"c_{c}"), F.lit(False)))
    for c in other:
        out = out & ~same_known(F.col(f"q_{c}"), F.col(f"c_{c}"))
    for columns, least in (at_least or {}).items():
        best = F.greatest(*[F.col(f"c_{c}") for c in columns]) if len(columns) > 1 else F.col(f"c_{columns[0]}")
        out = out & F.coalesce(best >= least, F.lit(True))
    return out


def filtered(candidates: DataFrame, condition: Column, k: int, relax: bool = True) -> DataFrame:
    """The k most similar candidates of each query that pass; if fewer than min(k, 3) do, all candidates count and ``relaxed`` says so."""
    query = Window.partitionBy("query_id")
    marked = candidates.withColumn("passes", condition)
    enough = F.sum(F.col("passes").cast("int")).over(query) >= min(k, 3)
    marked = marked.withColumn("relaxed", ~enough & F.lit(relax))
    kept = marked.where(F.col("passes") | F.col("relaxed"))
    order = query.orderBy(F.desc("similarity"), F.asc("case_id"))
    return kept.withColumn("neighbor", F.row_number().over(order)).where(F.col("neighbor") <= k).drop("passes")


def rescored(neighbors: DataFrame, blocks: list[str], context: tuple[str, ...], volume: tuple[str, ...] = (), missing: Column | None = None) -> DataFrame:
    """Add agreement, context, quality, final_score (6 places) and place: re-sorted inside the neighbours already chosen."""
    context_score = sum((same_known(F.col(f"q_{c}"), F.col(f"c_{c}")).cast("double") for c in context), F.lit(0.0)) / max(1, len(context))
    logs = [F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.col(f"c_{c}").cast("double"))) / 12) for c in volume]
    best = (F.greatest(*logs) if len(logs) > 1 else logs[0]) if logs else F.lit(0.0)
    quality = clip(1 - (F.lit(0.0) if missing is None else missing) + 0.15 * F.coalesce(best, F.lit(0.0)), 0, 1)
    out = neighbors.withColumns({"agreement": F.round(agreement(F.array(*blocks)), 6), "context": F.round(context_score, 6), "quality": F.round(quality, 6)})
    score = SCORING["global"] * F.col("similarity") + SCORING["agreement"] * F.col("agreement") + SCORING["context"] * F.col("context") + SCORING["quality"] * F.col("quality")
    out = out.withColumn("final_score", F.round(clip(score, -1, 1), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("case_id"))
    return out.withColumn("place", F.row_number().over(order))


def reasons(blocks: dict[str, str]) -> Column:
    """Why a neighbour was chosen, in a fixed order; blocks: a name of BLOCK_CODES and its similarity column."""
    same = lambda c: same_known(F.col(f"q_{c}"), F.col(f"c_{c}"))
    return F.array_compact(F.array(
        *[F.when(F.col(column) >= 0.75, BLOCK_CODES[name]) for name, column in blocks.items()],
        F.when(same("vertical"), "SAME_VERTICAL"),
        F.when(same("format"), "SAME_FORMAT"),
        F.when(F.col("quality") < 0.45, "LOW_DATA_QUALITY"),
        F.when(F.col("agreement") < 0.35, "LOW_BLOCK_AGREEMENT"),
        F.when(same("campaign_id"), "POSSIBLE_CAMPAIGN_DUPLICATE"),
    ))


def reuse_summary(neighbors: DataFrame, medians: tuple[str, ...] = ("roas", "ipm", "ctr", "cvr"), weighted: tuple[str, ...] = ("roas", "ipm")) -> DataFrame:
    """For each query: statistics of its neighbours' outcomes (c_perf and other c_ columns), shares of statuses, confidence.

    Shares and means are plain; the weighted means take final scores, those below 0 as 0, over
    known values. Confidence grows with the neighbours (ten suffice), their similarity and
    agreement (a null one counts as the similarity) and falls with the outcomes' spread.
    """
    weight = F.greatest(F.coalesce("final_score", "similarity"), F.lit(0.0))
    share = lambda *s: F.round(F.avg(F.coalesce(F.col("c_status").isin(*s), F.lit(False)).cast("double")), 6)
    known = F.count("c_perf")
    similar = clip(F.avg("similarity"), 0, 1)
    agreed = (F.sum(F.coalesce("agreement", F.lit(0.0))) + F.count(F.when(F.col("agreement").isNull(), 1)) * similar) / F.count("*")
    spread = F.when(known > 1, F.stddev_pop("c_perf")).otherwise(0.0)
    penalty = F.when(known > 0, F.least(F.lit(0.35), spread / (F.abs(F.avg("c_perf")) + 1e-6) * 0.1)).otherwise(0.1)
    confidence = clip(0.35 * F.least(F.lit(1.0), F.count("*") / 10) + 0.35 * similar + 0.25 * agreed - penalty, 0, 1)
    six = lambda x, name: F.round(x, 6).alias(name)
    return neighbors.groupBy("query_id").agg(
        F.count("*").alias("neighbors"),
        six(F.avg("similarity"), "avg_similarity"),
        six(F.avg("final_score") + 1e-9, "avg_final_score"),
        six(F.median("c_perf"), "median_perf"),
        six(F.avg("c_perf"), "mean_perf"),
        *[six(F.median(f"c_{c}"), f"median_{c}") for c in medians],
        share("top_performer").alias("top_ratio"),
        share(*FATIGUED).alias("fatigued_ratio"),
        share("stable").alias("stable_ratio"),
        six(weighted_mean(F.col("c_perf"), weight), "weighted_perf"),
        *[six(weighted_mean(F.col(f"c_{c}"), weight), f"weighted_{c}") for c in weighted],
        F.round(confidence + 1e-9, 6).alias("confidence"),
    )


def recommended_action() -> Column:
    """Over a reuse summary: the first rule that holds; what isn't known counts as 0."""
    n, confidence, top, tired, perf = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("neighbors", "confidence", "top_ratio", "fatigued_ratio", "weighted_perf"))
    return cases_of(
        ((n < 3) | (confidence < 0.35), "INVESTIGATE"),
        ((top >= 0.55) & (perf >= 0) & (tired <= 0.35) & (confidence >= 0.55), "SCALE"),
        ((tired >= 0.55) & (perf <= 0) & (confidence >= 0.5), "PAUSE"),
        ((top < 0.45) & (confidence >= 0.45), "PIVOT"),
        otherwise="INVESTIGATE",
    )


def repetition_features(neighbors: DataFrame, metadata: tuple[str, ...], near: float = 0.80) -> DataFrame:
    """For each query: mean similarity of the first 5 and 10, the greatest, how many reach ``near``, the share of equal metadata among the first 10."""
    first = lambda n, x: F.when(F.col("neighbor") <= n, x)
    alike = sum((same_known(F.col(f"q_{c}"), F.col(f"c_{c}")).cast("double") for c in metadata), F.lit(0.0)) / max(1, len(metadata))
    return neighbors.groupBy("query_id").agg(
        F.round(F.avg(first(5, F.col("similarity"))), 6).alias("top5_similarity"),
        F.round(F.avg(first(10, F.col("similarity"))), 6).alias("mean_similarity"),
        F.round(F.max("similarity"), 6).alias("max_similarity"),
        F.count(F.when(F.col("similarity") >= near, 1)).alias("dense"),
        F.round(F.avg(first(10, alike)), 6).alias("metadata_share"),
    )


def query_metrics(neighbors: DataFrame) -> DataFrame:
    """For each query of re-scored neighbours (by place): agreement of labels, top performers hit, nDCG of equal labels, predicted outcome.

    q_status and c_status are the labels, c_tired and q_tired whether a case tires; nDCG takes
    as its ideal the retrieved labels in the best order, 0 where none is equal. The prediction
    weighs outcomes by final scores, those below 0 as 0; an unknown outcome counts as the
    known ones' mean, and where all weights are 0 that mean is the prediction.
    """
    same = F.coalesce(F.col("q_status") == F.col("c_status"), F.lit(False)).cast("double")
    top = F.max((F.coalesce(F.col("q_status") == "top_performer", F.lit(False)) & F.coalesce(F.col("c_status") == "top_performer", F.lit(False))).cast("double"))
    weight = F.greatest(F.col("final_score"), F.lit(0.0))
    gain = F.sum(same / F.log2(F.col("place") + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.sum(same).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    unknown = F.sum(F.when(F.col("c_perf").isNull(), weight).otherwise(0.0))
    mean = F.avg("c_perf")
    return neighbors.groupBy("query_id").agg(
        F.round(F.avg(same), 6).alias("label_consistency"),
        F.round(top, 6).alias("hit_top_performer"),
        F.round(F.when(F.sum(same) > 0, gain / ideal).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.avg(F.col("q_tired").eqNullSafe(F.col("c_tired")).cast("double")), 6).alias("fatigue_consistency"),
        F.round(F.when((F.sum(weight) > 0) & mean.isNotNull(), (F.sum(F.coalesce(F.col("c_perf") * weight, F.lit(0.0))) + unknown * mean) / F.sum(weight)).otherwise(mean), 6).alias("predicted"),
        F.max(F.coalesce(F.col("q_perf"), F.lit(None))).alias("actual"),
        F.max((F.col("query_id") == F.col("case_id")).cast("int")).alias("self_found"),
    )


def guarded_correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson's correlation; null for fewer than three pairs or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.count(x) >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.round(F.corr(x, y), 6))


def patterns(neighbors: DataFrame, categories: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """(query_id, feature, top_high, top_other, high_mean, other_mean): what sets a query's top performers apart from its other neighbours.

    top_*: the three most frequent values with their counts, ties by value; a missing value
    counts as ``None``. Queries without a top performer have no rows.
    """
    top = neighbors.withColumn("high", F.coalesce(F.col("c_status") == "top_performer", F.lit(False)))
    top = top.join(top.where("high").select("query_id").distinct(), "query_id", "left_semi")
    features = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"c_{c}").cast("string"), F.lit("None")).alias("value"), F.lit(None).cast("double").alias("number")) for c in categories]
    features += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("value"), F.col(f"c_{c}").cast("double").alias("number")) for c in numbers]
    long = top.select("query_id", "high", F.explode(F.array(*features)).alias("f")).select("query_id", "high", "f.*")
    counts = long.groupBy("query_id", "feature", "high", "value").agg(F.count("*").alias("n"), F.avg("number").alias("mean"))

    def side(high: bool, name: str) -> tuple[Column, Column]:
        mine = F.when((F.col("high") == high) & F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value"))
        first = F.slice(F.sort_array(F.collect_list(mine)), 1, 3)
        shown = F.array_join(F.transform(first, lambda x: F.concat_ws(":", x["value"], (-x["n"]).cast("string"))), ",")
        return F.when(F.max("value").isNotNull(), shown).alias(f"top_{name}"), F.round(F.max(F.when(F.col("high") == high, F.col("mean"))), 6).alias(f"{name}_mean")

    return counts.groupBy("query_id", "feature").agg(*side(True, "high"), *side(False, "other"))


def filtered_stepwise(candidates: DataFrame, conditions: list[Column], k: int) -> DataFrame:
    """The older relaxation: each filter in turn counts for a query only if min(k, 3) candidates still pass it."""
    query = Window.partitionBy("query_id")
    for condition in conditions:
        enough = F.sum(condition.cast("int")).over(query) >= min(k, 3)
        candidates = candidates.withColumn("_keep", condition | ~enough).where("_keep").drop("_keep")
    order = query.orderBy(F.desc("similarity"), F.asc("case_id"))
    return candidates.withColumn("neighbor", F.row_number().over(order)).where(F.col("neighbor") <= k)


def explanations(neighbors: DataFrame, blocks: list[str], n: int = 3) -> DataFrame:
    """For each query: the mean of each block, its strongest blocks in order, and the evidence as JSON."""
    means = neighbors.groupBy("query_id").agg(F.count("*").alias("neighbors"), *[F.round(F.avg(b), 6).alias(b) for b in blocks])
    ordered = F.sort_array(F.array(*[F.struct((-F.col(b)).alias("v"), F.lit(b).alias("name")) for b in blocks]))
    drivers = F.array_join(F.transform(F.slice(ordered, 1, n), lambda x: x["name"]), ",")
    return means.withColumn("drivers", drivers).withColumn("evidence", F.to_json(F.struct("neighbors", *blocks), {"ignoreNullFields": "false"}))
