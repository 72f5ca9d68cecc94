"""Feature blocks: column selection, fitted statistics, transformed rows, PCA."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, norm
from .order import column_quantiles
from .profile import numeric_columns

#: Column prefixes that each mode may not use.
FORBIDDEN = {"prelaunch": ("first_3d_", "first_7d_", "first_14d_", "lifecycle_", "overall_"), "early_3d": ("first_7d_", "first_14d_", "lifecycle_", "overall_"), "early_7d": ("first_14d_", "lifecycle_", "overall_"), "early_14d": ("lifecycle_", "overall_")}


@dataclass
class Block:
    """Which columns a block has, and its weight."""

    weight: float = 1.0
    prefixes: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    enabled: bool = True
    robust: bool = False
    extra: dict = field(default_factory=dict)

    def select(self, names: list[str]) -> list[str]:
        chosen = [c for c in names if c in self.columns or any(c.startswith(p) for p in self.prefixes)]
        return [c for c in chosen if not any(c.startswith(p) for p in self.exclude)]


def allowed_columns(df: DataFrame, mode: str, outcomes: tuple[str, ...] = (), most_missing: float = 0.8) -> list[str]:
    """Numeric columns that a mode may use: no outcome, no forbidden prefix, at most ``most_missing`` nulls (one pass)."""
    names = [c for c in numeric_columns(df) if c not in outcomes and not c.startswith(FORBIDDEN[mode])]
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names]).first() if names else {}
    return [c for c in names if (share[c] if share[c] is not None else 1.0) <= most_missing]


def require_target(names: list[str], target: str) -> None:
    """Evaluation needs its target column."""
    if target not in names:
        raise ValueError(f"the target column {target} is required for evaluation")


def leaking_columns(mode: str, names: list[str]) -> list[str]:
    return [c for c in names if c.startswith(FORBIDDEN[mode])]


def fit(df: DataFrame, columns: list[str], robust: bool = False) -> DataFrame:
    """One row for each column: median, center and spread (0 counts as 1) of the imputed column; nulls for a column without values."""
    values = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    medians = column_quantiles(values, {c: (c, 0.5) for c in columns})
    filled = values.select(*[F.coalesce(F.col(c), F.lit(medians[c])).alias(c) for c in columns])
    if robust:
        q = column_quantiles(filled, {f"{c} {p}": (c, p) for c in columns for p in (0.25, 0.5, 0.75)})
        stats = {c: (q[f"{c} 0.5"], None if medians[c] is None else q[f"{c} 0.75"] - q[f"{c} 0.25"]) for c in columns}
    else:
        row = filled.agg(*[f(c).alias(f"{name} {c}") for c in columns for name, f in (("center", F.avg), ("spread", F.stddev_pop))]).first()
        stats = {c: (row[f"center {c}"], row[f"spread {c}"]) for c in columns}
    rows = [(c, medians[c], center, spread if spread and spread > 0 else 1.0) for c, (center, spread) in stats.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, median double, center double, spread double")


def transform(df: DataFrame, stats: DataFrame, id_col: str, columns: list[str], name: str = "block") -> DataFrame:
    """(id, block): imputed, scaled rows of length 1. The statistics, a row for each column, are broadcast; rows that weren't fitted on are fine."""
    wide = stats.agg(F.map_from_entries(F.collect_list(F.struct("column_name", F.struct("median", "center", "spread")))).alias("_stats"))
    joined = df.crossJoin(F.broadcast(wide))
    def scaled(c: str):
        s = F.col("_stats")[c]
        return F.coalesce((F.coalesce(finite(F.col(c).cast("double")), s["median"]) - s["center"]) / s["spread"], F.lit(0.0))

    raw = joined.select(id_col, F.array(*[scaled(c) for c in columns]).alias("_raw"))
    return raw.select(id_col, F.transform("_raw", lambda v: v / norm(F.col("_raw"))).alias(name))


def missing_row_ratio(blocks: dict[str, list[str]]):
    """Mean over blocks of the share of a row's nulls in each; blocks without columns don't count."""
    shares = [sum((F.col(c).isNull().cast("double") for c in columns), F.lit(0.0)) / len(columns) for columns in blocks.values() if columns]
    return sum(shares, F.lit(0.0)) / max(1, len(shares))


def fit_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, level) of the fitted rows; a missing value is the level ``__missing__``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("level")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").distinct()


def one_hot(df: DataFrame, levels: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, column_name, level, weight): the non-zero places of each row's one-hot block at length 1; unknown levels have none.

    Levels are joined, not broadcast: they are as many as the columns have values.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("level")) for c in columns]))
    known = df.select(id_col, pairs.alias("p")).select(id_col, "p.*").join(levels, ["column_name", "level"])
    length = known.groupBy(id_col).agg(F.sqrt(F.count("*")).alias("length"))
    return known.join(length, id_col).select(id_col, "column_name", "level", F.round(1 / F.col("length"), 6).alias("weight"))


#: Modes by the beginnings of feature-set names.
MODES = ("early_3d", "early_7d", "early_14d", "prelaunch")


def mode_of(feature_set: str, default: str) -> str:
    return next((m for m in MODES if feature_set.startswith(m)), default)


def gate(df: DataFrame, wanted: list[str], mode: str, outcomes: tuple[str, ...] = (), metadata: tuple[str, ...] = (), categories: tuple[str, ...] = (), most_missing: float = 0.8) -> dict[str, str]:
    """What becomes of each wanted column: absent, outcome, forbidden, metadata, missing, text, or kept.

    ``categories``: columns of categorical blocks, which may be metadata and needn't be numbers.
    Null shares come from one pass. An empty table has no share that is too high.
    """
    out, numeric = {}, set(numeric_columns(df))
    for c in wanted:
        if c not in df.columns:
            out[c] = "absent"
        elif c in outcomes:
            out[c] = "outcome"
        elif c.startswith(FORBIDDEN.get(mode, ())):
            out[c] = "forbidden"
        elif c in metadata and c not in categories:
            out[c] = "metadata"
    left = [c for c in wanted if c not in out]
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in left]).first() if left else {}
    for c in left:
        out[c] = "missing" if (share[c] or 0.0) > most_missing else "kept" if c in numeric or c in categories else "text"
    return {c: out[c] for c in wanted}


def category_similarity(a: list, b: list):
    """Share of equal one-hot columns; a missing value is a level of its own."""
    same = [F.coalesce(x.cast("string"), F.lit("__missing__")) == F.coalesce(y.cast("string"), F.lit("__missing__")) for x, y in zip(a, b)]
    return sum((s.cast("double") for s in same), F.lit(0.0)) / len(same)


def landscape(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, y): the first two principal components, centred first, scaled to -1 .. 1; a sign per axis is arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = df.select(F.size(vector_col)).first()[0]
    v = F.col(vector_col)
    means = df.agg(F.array(*[F.avg(v[i]) for i in range(width)]).alias("_mean"))
    centred = df.crossJoin(F.broadcast(means)).select(id_col, array_to_vector(F.zip_with(v, "_mean", lambda x, m: x.cast("double") - m)).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(centred)
    flat = model.transform(centred).select(id_col, vector_to_array("_p").alias("p")).select(id_col, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    edge = flat.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), 2 * (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo")) - 1).otherwise(0.0)
    return flat.crossJoin(F.broadcast(edge)).select(id_col, scale("x").alias("x"), scale("y").alias("y"))
