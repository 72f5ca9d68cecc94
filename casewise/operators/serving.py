"""What a caller asks: lists, search, details, options, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import normalize_text


def clamp(value, least: int, most: int, default: int) -> int:
    """An integer within bounds; the default for what isn't one."""
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def equals_any_case(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Rows whose columns equal the given values in any case; an empty value filters nothing."""
    for column, value in filters.items():
        if value:
            df = df.where(F.lower(column) == value.lower())
    return df


def search(df: DataFrame, text: str, columns: tuple[str, ...], id_col: str) -> DataFrame:
    """Rows whose joined, normalised columns contain the text; a number is also sought in the id."""
    if not text.strip():
        return df
    found = normalize_text(F.concat_ws(" ", *columns)).contains(normalize_text(F.lit(text)))
    if text.strip().isdigit():
        found = found | F.col(id_col).cast("string").contains(text.strip())
    return df.where(found)


def page(df: DataFrame, order: tuple, limit=100, offset=0) -> DataFrame:
    """One page in a given order, with the number of all rows in ``total``."""
    total = df.agg(F.count("*").alias("total"))
    few = df.orderBy(*order).offset(clamp(offset, 0, 100_000, 0)).limit(clamp(limit, 1, 2000, 100))
    return few.crossJoin(F.broadcast(total))


def options(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("option")).distinct()


def keyed_union(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Full outer union of keyed tables, each as one struct column under its name."""
    out = None
    for name, df in tables.items():
        one = df.select(F.col(key).alias("_key"), F.struct(*[c for c in df.columns if c != key]).alias(name))
        out = one if out is None else out.join(one, "_key", "full")
    return out.withColumnRenamed("_key", key)


def highlight(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, sets): which of the named sets have a key."""
    out = None
    for name, df in sets.items():
        one = df.select(key, F.lit(name).alias("label")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("sets"))
