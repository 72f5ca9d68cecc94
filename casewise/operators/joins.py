"""Joins with contracts: kinds by name, backfill, membership and consistency checks, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_div

HOWS = ("left", "inner", "right", "outer")


def join_tables(left: DataFrame, right: DataFrame, key: str, how: str = "left", order: tuple[Column, ...] = (), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Join on a key that both have, read as a number; the right side's first row of each key counts, columns that the left has too are left out."""
    if how not in HOWS:
        raise ValueError(f"how must be one of {', '.join(HOWS)}")
    extra = [c for c in right.columns if c != key and c not in left.columns and (keep is None or c in keep)]
    first = Window.partitionBy("_key").orderBy(*(order or (F.col(key),)))
    b = right.withColumn("_key", F.col(key).cast("string").try_cast("bigint")).withColumn("_n", F.row_number().over(first)).where("_n = 1 AND _key IS NOT NULL").select("_key", *extra)
    a = left.withColumn("_left", F.col(key).cast("string").try_cast("bigint"))
    out = a.join(b, F.col("_left") == F.col("_key"), how)
    return out.withColumn(key, F.coalesce(F.col(key), F.col("_key").cast(dict(left.dtypes)[key]))).drop("_left", "_key")


def backfill(df: DataFrame, other: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Nulls of the named columns from another table with the same key (its rows must be unique)."""
    b = other.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(b, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") if c in df.columns else F.col(f"_{c}") for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def membership(value: Column, listed: Column, sep: str = "|", any_word: str | None = None) -> Column:
    """Whether a delimited list has a value; ``any_word`` in the list admits all; null if either is null."""
    items = F.transform(F.split(listed, f"\\{sep}"), lambda x: F.trim(x))
    found = F.array_contains(items, value)
    return found | F.array_contains(items, any_word) if any_word else found


def consistency(facts: DataFrame, dim: DataFrame, key: str, column: str) -> DataFrame:
    """One row: facts, facts without a dimension row, facts whose column differs from the dimension's (nulls equal)."""
    b = dim.select(F.col(key).alias("_key"), F.col(column).alias("_value"), F.lit(1).alias("_known"))
    joined = facts.join(b, F.col(key) == F.col("_key"), "left")
    differs = F.col("_known").isNotNull() & ~F.col(column).eqNullSafe(F.col("_value"))
    return joined.agg(F.count("*").alias("facts"), F.count(F.when(F.col("_known").isNull(), 1)).alias("unknown"), F.count(F.when(differs, 1)).alias("inconsistent"))


def coverage(df: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each family of columns: rows with any of them present, and their share."""
    rows = [F.struct(F.lit(k).alias("family"), F.count(F.coalesce(*[F.col(c).cast("string") for c in v])).alias("covered"), F.count("*").alias("row_count")) for k, v in families.items()]
    long = df.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    return long.withColumn("share", F.round(safe_div(F.col("covered"), F.col("row_count")), 6))


def duplicate_policy(df: DataFrame, key: str, policy: str, order: tuple[Column, ...]) -> DataFrame:
    """error: raise if a key repeats; keep_first: by an explicit order; aggregate: mean of numbers, first present of the rest."""
    from .facts import assert_unique, keep_first
    from .profile import numeric_columns

    if policy == "error":
        return assert_unique(df, (key,))
    if policy == "keep_first":
        return keep_first(df, (key,), order)
    if policy != "aggregate":
        raise ValueError("policy must be error, keep_first or aggregate")
    numbers = set(numeric_columns(df))
    rank = F.struct(*order)
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank))
    return df.groupBy(key).agg(*[(F.avg(c) if c in numbers else first(c)).alias(c) for c in df.columns if c != key])


def temporal_split(df: DataFrame, time: str, key: str, share: float = 0.8, least: int = 3) -> DataFrame:
    """Add is_train: the oldest rows, ``max(least, int(share * n))`` of them; ties by key. The cut is one row's value, so no window runs over the table."""
    from .order import value_table

    n = df.count()
    cut = max(least, int(share * n))
    times = value_table(df.select(F.unix_seconds(F.col(time).cast("timestamp")).alias("t")), "t")
    edge = times.where((F.col("less") < cut) & (F.col("less") + F.col("n") >= cut)).first()
    if edge is None:
        return df.withColumn("is_train", F.lit(True))
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    if edge.n == 1:
        return df.withColumn("is_train", F.coalesce(at <= edge.t, F.lit(False)))
    ties = value_table(df.where(at == edge.t).select(key), key).select(F.col(key).alias("_key"), F.col("less").alias("_less"))
    out = df.join(ties, (F.col(key) == F.col("_key")) & (at == edge.t), "left")
    return out.withColumn("is_train", F.coalesce((at < edge.t) | (F.col("_less") < cut - edge.less), F.lit(False))).drop("_key", "_less")


def folds(df: DataFrame, n: int, group: str, seed: int = 0) -> DataFrame:
    """Add fold, 0 to n - 1: by a seeded hash of the group, so that a group stays together."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(n)).cast("int"))
