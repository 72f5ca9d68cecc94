"""Which cases work best: evidence, blended percent ranks, segments, ranks and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cases_of, rounded
from ..sources.scratch import Scratch
from .order import Rank, column_quantiles, quantile, with_ranks

#: Weights of the percent ranks, and what a top performer gets on top.
WEIGHTS = {"perf_score": 0.40, "roas": 0.25, "ipm": 0.20, "cvr": 0.10, "ctr": 0.05}
TOP_BONUS = 0.03
EVIDENCE_SHARE, TOP_SHARE = 0.25, 0.90


def winner_ranking(cases: DataFrame) -> DataFrame:
    """Add has_evidence, <metric>_pct, best_score (6 places; null without evidence), segment, hint.

    A case has evidence if its spend or its impressions reach the lower quartile; percent
    ranks count cases with evidence only, a missing one as 0. Steps that are read several
    times are tables in the shared folder, so plans stay short.
    """
    scratch = Scratch(cases.sparkSession, "ranking")
    cases = scratch.table(cases)
    floors = column_quantiles(cases, {c: (c, EVIDENCE_SHARE) for c in ("spend", "impressions")})
    enough = (F.col("spend") >= F.lit(floors["spend"])) | (F.col("impressions") >= F.lit(floors["impressions"]))
    marked = cases.withColumn("has_evidence", F.coalesce(enough, F.lit(False)))
    marked = marked.withColumns({f"_{m}": F.when(F.col("has_evidence"), F.col(m)) for m in WEIGHTS})
    out = with_ranks(marked, *[Rank(f"_{m}", percent=f"{m}_pct") for m in WEIGHTS]).drop(*[f"_{m}" for m in WEIGHTS])
    blended = sum((F.coalesce(F.col(f"{m}_pct"), F.lit(0.0)) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    bonus = F.when(F.col("status") == "top_performer", TOP_BONUS).otherwise(0.0)
    out = scratch.table(out.withColumn("best_score", F.when(F.col("has_evidence"), rounded(blended + bonus, 6))))
    top = quantile(out, "best_score", TOP_SHARE)
    is_top = F.col("best_score") >= rounded(F.lit(top), 6)
    status = F.col("status")
    segment = cases_of((~F.col("has_evidence"), "low_evidence"), (is_top & (status == "fatigued"), "strong_but_fatigued"), (is_top & (status == "top_performer"), "top_winner"), (is_top, "strong_candidate"), otherwise="not_top")
    out = out.withColumn("segment", segment)
    segment = F.col("segment")
    hint = cases_of((segment == "low_evidence", "Gather more data"), (segment == "strong_but_fatigued", "Refresh"), (segment == "top_winner", "Scale"), (segment == "strong_candidate", "Keep"), otherwise="Review")
    return out.withColumn("hint", hint)


def add_group_ranks(ranking: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each named grouping: <name>_rank, <name>_pct, <name>_size of best_score."""
    return with_ranks(ranking, *[Rank("best_score", by, f"{name}_pct", f"{name}_rank", f"{name}_size") for name, by in groups.items()])


def top_by_group(ranking: DataFrame, by: tuple[str, ...], n: int, score: str = "best_score", key: str = "case_id") -> DataFrame:
    """The n best cases with evidence of each group; ties go to the lesser key."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return ranking.where("has_evidence").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def contextual_benchmarks(ranking: DataFrame, metrics: tuple[str, ...], groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each metric's group median, the difference from it and whether it is above."""
    for name, by in groups.items():
        medians = ranking.groupBy(*by).agg(*[F.median(m).alias(f"{name}_{m}_median") for m in metrics])
        ranking = ranking.join(medians, list(by), "left")
        for m in metrics:
            delta = F.col(m) - F.col(f"{name}_{m}_median")
            ranking = ranking.withColumns({f"{name}_{m}_delta": delta, f"{name}_{m}_above": delta > 0})
    return ranking
