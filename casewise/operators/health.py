"""What looks tired or repetitive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cases_of, clip
from ..sources.scratch import Scratch
from .order import Rank, column_quantiles, with_ranks


def tired_scores(cases: DataFrame) -> DataFrame:
    """Add label_score, ctr_severity, cvr_severity, early_severity and tired_score.

    A decay counts by its size over the 95th percentile of all (nulls as 0); fatigue counts
    the more the earlier its day. All are 0 where that percentile is 0.
    """
    drop = {k: F.greatest(F.lit(0.0), F.coalesce(-F.col(f"{k}_decay"), F.lit(0.0))) for k in ("ctr", "cvr")}
    out = Scratch(cases.sparkSession, "health").table(cases.withColumns({f"_{k}": v for k, v in drop.items()}))
    top = {c: q or 0.0 for c, q in column_quantiles(out, {c: (c, 0.95) for c in ("_ctr", "_cvr", "fatigue_day")}).items()}
    severity = lambda k: F.least(F.lit(1.0), F.col(f"_{k}") / top[f"_{k}"]) if top[f"_{k}"] > 0 else F.lit(0.0)
    early = F.coalesce(clip(1 - F.col("fatigue_day") / top["fatigue_day"], 0, 1), F.lit(0.0)) if top["fatigue_day"] > 0 else F.lit(0.0)
    label = F.greatest((F.col("status") == "fatigued").cast("double"), F.col("has_fatigue").cast("double"))
    out = out.withColumns({"label_score": label, "ctr_severity": severity("ctr"), "cvr_severity": severity("cvr"), "early_severity": early})
    score = 0.35 * F.col("label_score") + 0.25 * F.col("ctr_severity") + 0.20 * F.col("cvr_severity") + 0.20 * F.col("early_severity")
    return out.withColumn("tired_score", F.round(score, 6)).drop("_ctr", "_cvr")


def repetition(neighbors: DataFrame, metadata: tuple[str, ...], near: float = 0.80) -> DataFrame:
    """For each case: how alike its neighbours (q_ and c_ columns, numbered by likeness) are.

    Mean similarity of the first 5 and 10, the greatest, how many reach ``near``, the mean
    share of equal metadata (two missing values are equal) and of fatigued ones among the first 10.
    """
    first = lambda n, x: F.avg(F.when(F.col("neighbor") <= n, x))
    share = sum((first(10, F.col(f"q_{c}").eqNullSafe(F.col(f"c_{c}")).cast("double")) for c in metadata), F.lit(0.0)) / max(1, len(metadata))
    return neighbors.groupBy("query_id").agg(
        F.count("*").alias("similar_cases"),
        F.round(first(5, F.col("similarity")), 4).alias("avg_top5_similarity"),
        F.round(first(10, F.col("similarity")), 4).alias("avg_top10_similarity"),
        F.round(F.max("similarity"), 4).alias("max_similarity"),
        F.count(F.when(F.col("similarity") >= near, 1)).alias("dense_neighbors"),
        F.round(share, 4).alias("same_metadata_ratio"),
        F.round(first(10, F.coalesce(F.col("c_status") == "fatigued", F.lit(False)).cast("double")), 4).alias("fatigued_neighbor_ratio"),
    )


REPETITION = ("similar_cases", "avg_top5_similarity", "avg_top10_similarity", "max_similarity", "dense_neighbors", "same_metadata_ratio", "fatigued_neighbor_ratio")


def repetition_scores(cases: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """Add repetition features, 0 for cases without neighbours, and repetition_score.

    The score is half the percent rank of the mean similarity of the first ten, a quarter each
    the metadata share and the percent rank of the near neighbours' number.
    """
    out = cases.join(features.withColumnRenamed("query_id", id_col), id_col, "left").na.fill(0, list(REPETITION))
    out = with_ranks(Scratch(cases.sparkSession, "repetition").table(out), Rank("avg_top10_similarity", percent="_mean"), Rank("dense_neighbors", percent="_dense"))
    score = 0.50 * F.col("_mean") + 0.25 * F.col("same_metadata_ratio") + 0.25 * F.col("_dense")
    return out.withColumn("repetition_score", F.round(clip(score, 0, 1) + 1e-9, 6)).drop("_mean", "_dense")


def with_status(df: DataFrame) -> DataFrame:
    """Add fatigue_status, repetition_status, risk and health_hint."""
    tired, repeated = F.col("tired_score"), F.col("repetition_score")
    out = df.withColumns({
        "fatigue_status": cases_of((tired >= 0.65, "tired"), (tired >= 0.40, "at_risk"), otherwise="healthy"),
        "repetition_status": cases_of((repeated >= 0.75, "high_repetition"), (repeated >= 0.55, "moderate_repetition"), otherwise="distinct"),
        "risk": F.greatest(tired, repeated),
    })
    first = (F.col("fatigue_status") == "tired") | (F.col("repetition_status") == "high_repetition")
    second = (F.col("fatigue_status") == "at_risk") | (F.col("repetition_status") == "moderate_repetition")
    return out.withColumn("health_hint", cases_of((first, "Refresh"), (second, "Monitor"), otherwise="Keep"))
