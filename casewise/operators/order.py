"""Exact ranks and quantiles of whole tables without one task that sorts all rows.

Equal values are counted first. The distinct values are dealt over ranges (cut at approximate
percentiles, at most ``CUTS`` of them), ranked within their range, and shifted by the counts of
the ranges below, a table of at most ``CUTS`` + 1 rows for each group.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

CUTS = 127
ACCURACY, FEW = 1000, 100_000  # of approximate percentiles; values that the driver sorts at most


def value_table(df: DataFrame, col: str, by: tuple[str, ...] = (), cut_by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, col, less, n, total): how many non-null values are less, equal, and in all, for each distinct value.

    ``cut_by``: columns of ``by``, of few values, whose groups get cuts of their own.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*cut_by).agg(F.percentile_approx(col, F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)]), 1000).alias("cuts"))
    cuts = Scratch(df.sparkSession, "cuts").table(cuts)  # they depend on the order of merging, and two branches below must see the same
    cut = counts.join(F.broadcast(cuts), list(cut_by)) if cut_by else counts.crossJoin(F.broadcast(cuts))
    dealt = cut.withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col(col)))).drop("cuts")
    sums = dealt.groupBy(*by, "range").agg(F.sum("n").alias("in_range"))
    before = Window.partitionBy(*by).orderBy("range")
    sums = sums.withColumn("below", F.sum("in_range").over(before) - F.col("in_range")).withColumn("total", F.sum("in_range").over(Window.partitionBy(*by)))
    within = Window.partitionBy(*by, "range").orderBy(col)
    ranked = dealt.withColumn("up_to", F.sum("n").over(within))
    sums = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("range").alias("_range"), "below", "total")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "range")]
    return ranked.join(sums, on).select(*by, col, (F.col("below") + F.col("up_to") - F.col("n")).alias("less"), "n", "total")


class Rank(NamedTuple):
    """Names for the ranks of ``col`` to add. percent: average-tie rank over the non-null count;
    descending: 1 for the greatest, ties share the least rank; size: non-null count."""

    col: str
    by: tuple[str, ...] = ()
    percent: str | None = None
    descending: str | None = None
    size: str | None = None


def with_ranks(df: DataFrame, *ranks: Rank) -> DataFrame:
    """Add ranks of numbers; null for a null value.

    Columns ranked within the same groups are counted together, in one long table that is
    written and read again; then each joins its values.
    """
    out, scratch = df, Scratch(df.sparkSession, "ranks")
    for i, by in enumerate(dict.fromkeys(r.by for r in ranks)):
        own = [r for r in ranks if r.by == by]
        metrics = F.explode(F.array(*[F.struct(F.lit(k).alias("_metric"), F.col(r.col).cast("double").alias("_value")) for k, r in enumerate(own)]))
        long = df.select(*by, metrics.alias("m")).select(*by, "m._metric", "m._value")
        values = scratch.table(value_table(long, "_value", (*by, "_metric"), ("_metric",)))
        for k, r in enumerate(own):
            place = F.col("less") + (F.col("n") + 1) / 2
            found = {r.percent: place / F.col("total"), r.descending: F.col("total") - F.col("less") - F.col("n") + 1, r.size: F.col("total")}
            keys = [F.col(c).alias(f"_{i}_{k}_{j}") for j, c in enumerate((*by, "_value"))]
            side = values.where(F.col("_metric") == k).select(*keys, *[x.alias(name) for name, x in found.items() if name])
            on = [F.col(c).eqNullSafe(F.col(f"_{i}_{k}_{j}")) for j, c in enumerate(by)] + [F.col(r.col).cast("double") == F.col(f"_{i}_{k}_{len(by)}")]
            out = out.join(side, on, "left").drop(*[f"_{i}_{k}_{j}" for j in range(len(by) + 1)])
    return out


def quantile(df: DataFrame, col: str, share: float) -> float | None:
    """One exact quantile of a whole column, as a number."""
    return column_quantiles(df, {col: (col, share)})[col]


def column_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> dict[str, float | None]:
    """Exact quantiles (linear interpolation) of whole columns; wanted: name -> (column, share). None for a column of nulls.

    Approximate percentiles bracket each quantile; rows below the bracket are counted and the
    distinct values inside it, few by then, come to the driver. A bracket that still has more
    than ``FEW`` values is narrowed in the same way.
    """
    margin, todo, out = 2.0 / ACCURACY, {}, {}
    own = {name: (F.col(f"`{c}`").cast("double"), p) for name, (c, p) in wanted.items()}

    def bracket(x: Column, p: float) -> Column:
        return F.percentile_approx(x, F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), ACCURACY)

    first = df.agg(*[e for name, (x, p) in own.items() for e in (F.count(x).alias(f"{name}_n"), bracket(x, p).alias(f"{name}_b"))]).first()
    for name, (_, p) in own.items():
        n = first[f"{name}_n"]
        out[name] = None
        if n:
            todo[name] = (p * (n - 1), *first[f"{name}_b"])
    tries = 0
    while todo:
        tries += 1
        below = df.agg(*[F.count(F.when(own[name][0] < lo, 1)).alias(name) for name, (_, lo, _) in todo.items()]).first()
        rows = {}
        for name, (place, lo, hi) in list(todo.items()):
            x = own[name][0]
            inside = df.where((x >= lo) & (x <= hi)).groupBy(x.alias("v")).count()
            rows[name] = sorted(tuple(r) for r in inside.limit(FEW + 1).collect())
            found = rows[name]
            if len(found) <= FEW:
                ends = below[name] + np.cumsum([c for _, c in found])
                if below[name] <= int(place) and (len(ends) and ends[-1] > math.ceil(place)):
                    low, high = (found[int(np.searchsorted(ends, k, side="right"))][0] for k in (math.floor(place), math.ceil(place)))
                    share = place - math.floor(place)
                    out[name] = math.fma(low, 1 - share, high * share) if share else low  # as the SQL engine does, to the last bit
                    del todo[name]
                else:  # the approximation missed it: everything, to be narrowed
                    todo[name] = (place, -math.inf, math.inf)
            else:
                m = df.where((x >= lo) & (x <= hi)).count()
                p = min(1.0, max(0.0, (place - below[name]) / m))
                todo[name] = (place, *df.where((x >= lo) & (x <= hi)).agg(bracket(x, p)).first()[0])
        if tries > 20:  # brackets that don't narrow: many equal approximations
            for name in todo:
                out[name] = quantiles(df, wanted[name][0], {"q": wanted[name][1]}).first()[0]
            break
    return out


def quantiles(df: DataFrame, col: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: a row for each group (one in all without ``by``)."""
    values = value_table(df, col, by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("less") <= place) & (place < F.col("less") + F.col("n")), F.col(col)))

    out = []
    for name, p in shares.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return values.groupBy(*by).agg(*out)
