"""Facts: daily rollups, rates, rolling and early windows, lifecycle, dimensions, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import micros, safe_div


class ContractError(ValueError):
    """A key, foreign key or cardinality contract that doesn't hold."""


def rollup_days(events: DataFrame, entity: str = "user_id", ts: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """One row for each entity and day: counts of each kind of event, revenue, and rows."""
    is_kind = lambda k: F.col(kind) == k
    count = lambda k: F.sum(F.when(is_kind(k), 1).otherwise(0))
    return events.groupBy(entity, F.to_date(ts).alias("day")).agg(
        count("view").alias("impressions"),
        count("click").alias("clicks"),
        count("purchase").alias("conversions"),
        count("signup").alias("signups"),
        count("error").alias("errors"),
        (F.sum(F.when(is_kind("purchase"), micros(F.col(value))).otherwise(0)) / 10000).alias("revenue"),
        F.count("*").alias("fact_rows"),
    )


def with_rates(df: DataFrame) -> DataFrame:
    """Add ctr, cvr, ipm and rpi, each where its inputs exist; null where the denominator is 0."""
    has = set(df.columns)
    rates = {"ctr": ("clicks", "impressions", 1), "cvr": ("conversions", "clicks", 1), "ipm": ("conversions", "impressions", 1000), "rpi": ("revenue", "impressions", 1), "roas": ("revenue", "spend", 1)}
    return df.withColumns({k: F.round(safe_div(F.col(n) * m, F.col(d)), 6) for k, (n, d, m) in rates.items() if n in has and d in has})


def rolling_previous(days: DataFrame, columns: tuple[str, ...], widths: tuple[int, ...] = (3, 7, 14), entity: str = "user_id", calendar: bool = False) -> DataFrame:
    """Sums over the w rows (or, ``calendar``, the w days) before each day, 0 where there are none."""
    if calendar:
        order = Window.partitionBy(entity).orderBy(F.unix_date("day"))
        frames = {w: order.rangeBetween(-w, -1) for w in widths}
    else:
        order = Window.partitionBy(entity).orderBy("day")
        frames = {w: order.rowsBetween(-w, -1) for w in widths}
    name = "cal" if calendar else "prev"
    return days.withColumns({f"{c}_{name}_{w}d": F.coalesce(F.sum(c).over(f), F.lit(0)) for w, f in frames.items() for c in columns})


def rolling_rates(rolled: DataFrame, widths: tuple[int, ...] = (3, 7, 14), name: str = "prev") -> DataFrame:
    """Add ctr, cvr, ipm and (where there is spend) roas of the sums over previous days; null where the denominator is 0."""
    has, out = set(rolled.columns), {}
    for w in widths:
        for rate, (n, d, m) in {"ctr": ("clicks", "impressions", 1), "cvr": ("conversions", "clicks", 1), "ipm": ("conversions", "impressions", 1000), "roas": ("revenue", "spend", 1)}.items():
            top, below = f"{n}_{name}_{w}d", f"{d}_{name}_{w}d"
            if {top, below} <= has:
                out[f"{rate}_{name}_{w}d"] = F.round(safe_div(F.col(top) * m, F.col(below)), 6)
    return rolled.withColumns(out)


def early_windows(days: DataFrame, entity: str = "user_id", widths: tuple[int, ...] = (3, 7, 14)) -> DataFrame:
    """For each entity and window: active days, sums, spread of daily ctr, ratios of sums.

    All windows come from one aggregation: a day counts in a window if it is at most w - 1
    days after the entity's first.
    """
    first = days.groupBy(F.col(entity).alias("_entity")).agg(F.min("day").alias("first_day"))
    aged = days.join(first, F.col(entity) == F.col("_entity")).withColumn("age", F.datediff("day", "first_day"))
    out = []
    for w in widths:
        inside = lambda c, w=w: F.when(F.col("age") < w, c)
        out += [F.count(inside(F.lit(1))).alias(f"first_{w}d_active_days")]
        out += [F.coalesce(F.sum(inside(F.col(c))), F.lit(0)).alias(f"first_{w}d_{c}") for c in ("impressions", "clicks", "conversions")]
        out += [F.round(F.stddev_samp(inside(safe_div(F.col("clicks"), F.col("impressions")))), 6).alias(f"first_{w}d_ctr_std")]
        out += [F.round(safe_div(F.sum(inside(F.col("clicks"))), F.sum(inside(F.col("impressions")))), 6).alias(f"first_{w}d_ctr")]
    return aged.groupBy(entity).agg(*out)


def lifecycle(days: DataFrame, entity: str = "user_id") -> DataFrame:
    """Whole-life sums, span, peak and ratios of each entity."""
    sums = days.groupBy(entity).agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count("*").alias("active_days"),
        *[F.sum(c).alias(c) for c in ("impressions", "clicks", "conversions", "fact_rows")],
        (F.sum(micros(F.col("revenue"))) / 10000).alias("revenue"),
        F.max("impressions").alias("peak_day_impressions"),
    )
    return with_rates(sums).withColumn("span_days", F.datediff("last_day", "first_day") + 1)


def enrich(facts: DataFrame, dim: DataFrame, keys: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Left join a dimension m:1. keys: fact column -> dim column; columns: dim column -> its name in the result."""
    right = dim.select(*[F.col(d).alias(f"_{d}") for d in keys.values()], *[F.col(c).alias(n) for c, n in columns.items()])
    on = [F.col(f) == F.col(f"_{d}") for f, d in keys.items()]
    return facts.join(right, on, "left").drop(*[f"_{d}" for d in keys.values()])


def unique_key_report(df: DataFrame, keys: tuple[str, ...], table: str) -> DataFrame:
    """table, rows, distinct_keys, duplicate_rows, null_key_rows. The keys are counted by two levels of aggregation."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("n")).otherwise(0)), F.lit(0)).alias("null_key_rows"),
    )


def assert_unique(df: DataFrame, keys: tuple[str, ...], table: str = "table") -> DataFrame:
    """df itself, or ContractError if a key repeats; stops at the first repeated key."""
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ContractError(f"{table}: {keys} is not unique")
    return df


def foreign_key_coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str, relation: str) -> DataFrame:
    """relation, left_keys, missing_keys, coverage of the left side's distinct non-null keys."""
    keys = left.select(F.col(left_key).alias("k")).where("k IS NOT NULL").distinct()
    known = right.select(F.col(right_key).alias("k"), F.lit(1).alias("known")).distinct()
    joined = keys.join(known, "k", "left")
    missing = F.count(F.when(F.col("known").isNull(), 1))
    return joined.agg(F.lit(relation).alias("relation"), F.count("*").alias("left_keys"), missing.alias("missing_keys"), F.round(safe_div(F.count("known"), F.count("*")), 6).alias("coverage"))


def assert_foreign_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left itself, or ContractError if some non-null key has no match."""
    if left.where(F.col(left_key).isNotNull()).join(right, left[left_key] == right[right_key], "left_anti").take(1):
        raise ContractError(f"{left_key} has values without a {right_key}")
    return left


def reconcile(summary: DataFrame, recomputed: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """Full outer comparison of two keyed tables: a row for each metric with counts of presence, null and value mismatches."""
    b = recomputed.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in tolerances])
    joined = summary.select(key, *tolerances).join(b, F.col(key) == F.col("_key"), "full")
    rows = [_compared(F.lit(c), F.col(c).cast("double"), F.col(f"_{c}").cast("double"), t) for c, t in tolerances.items()]
    long = joined.select(F.col(key).isNull().alias("right_only"), F.col("_key").isNull().alias("left_only"), F.explode(F.array(*rows)).alias("m")).select("right_only", "left_only", "m.*")
    both = ~F.col("right_only") & ~F.col("left_only")
    return long.groupBy("metric").agg(
        F.count(F.when(F.col("left_only"), 1)).alias("left_only"),
        F.count(F.when(F.col("right_only"), 1)).alias("right_only"),
        F.count(F.when(both & F.col("null_mismatch"), 1)).alias("null_mismatches"),
        F.count(F.when(both & (F.col("gap") > F.col("tolerance")), 1)).alias("bad_rows"),
        F.round(F.max(F.when(both, F.col("gap"))), 6).alias("max_gap"),
    )


def _compared(name: Column, a: Column, b: Column, tolerance: float) -> Column:
    return F.struct(name.alias("metric"), (a.isNull() != b.isNull()).alias("null_mismatch"), F.abs(a - b).alias("gap"), F.lit(float(tolerance)).alias("tolerance"))


def keep_first(df: DataFrame, keys: tuple[str, ...], order: tuple[Column, ...]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def not_yet_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run hasn't written."""
    return work.join(done.select(key).distinct(), key, "left_anti")
