"""Table and column audits, duplicate columns, correlations."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div
from .order import Rank, with_ranks

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def column_audit(df: DataFrame) -> DataFrame:
    """A row for each column: type, nulls, distinct values, share of them, constant, high_missing.

    One pass for the counts; distinct values are counted exactly, each column by its own partial aggregation.
    """
    stats = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.count("*").alias("row_count"), (F.count("*") - F.count(c)).alias("nulls"), F.countDistinct(c).alias("distinct_values")) for c, t in df.dtypes]
    long = df.agg(F.array(*stats).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    rows = F.col("row_count")
    return long.withColumns({
        "null_share": F.round(safe_div(F.col("nulls"), rows), 6),
        "unique_share": F.round(safe_div(F.col("distinct_values"), rows), 6),
        "is_constant": F.col("distinct_values") <= 1,
        "high_missing": F.coalesce(safe_div(F.col("nulls"), rows) > 0.8, F.lit(False)),
    })


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """One row: rows, columns, null cells and their share, rows that repeat another."""
    nulls = sum((F.count("*") - F.count(c) for c in df.columns), F.lit(0))
    cells = df.agg(F.count("*").alias("row_count"), nulls.alias("null_cells"))
    distinct = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    share = F.round(safe_div(F.col("null_cells"), F.col("row_count") * len(df.columns)), 6)
    return cells.crossJoin(F.broadcast(distinct)).select(F.lit(table).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count"), "null_cells", share.alias("null_share"), "duplicate_rows")


def duplicate_columns(df: DataFrame, key: str) -> list[tuple[str, str]]:
    """Pairs (kept, duplicate) of columns with equal values in all rows; the first of equals is kept.

    Columns of equal type and fingerprint (one aggregation over all) are then compared exactly.
    """
    names = [c for c in df.columns if c != key]
    kinds = dict(df.dtypes)
    prints = df.agg(*[F.bit_xor(F.xxhash64(F.col(key), F.col(c))).alias(c) for c in names]).first()
    groups: dict[tuple, list[str]] = {}
    for c in names:
        groups.setdefault((kinds[c], prints[c]), []).append(c)
    maybe = [(g[0], c) for g in groups.values() for c in g[1:]]
    if not maybe:
        return []
    same = df.agg(*[F.count(F.when(~F.col(a).eqNullSafe(F.col(b)), 1)).alias(f"{i}") for i, (a, b) in enumerate(maybe)]).first()
    return [pair for i, pair in enumerate(maybe) if same[i] == 0]


def correlations(df: DataFrame, pairs: list[tuple[str, str]], by: str | None = None, least: int = 10) -> DataFrame:
    """Spearman correlations of pairs, over rows where both are present: (segment,) a, b, n, spearman.

    A segment of fewer than ``least`` rows is left out; fewer than 3 rows or a constant side gives null.
    """
    out = None
    for a, b in pairs:
        both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        both = both.select(F.col(by).alias("segment") if by else F.lit("all").alias("segment"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        ranked = with_ranks(both, Rank("x", ("segment",), percent="rx"), Rank("y", ("segment",), percent="ry"))
        one = ranked.groupBy("segment").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("r"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        varied = (F.col("n") >= 3) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
        one = one.where(F.col("n") >= least).select("segment", F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.round(F.when(varied, F.col("r")), 6).alias("spearman"))
        out = one if out is None else out.unionByName(one)
    return out


def greedy_drop(pairs: list[tuple[str, str, float]], threshold: float) -> list[str]:
    """Columns to drop: pairs from the strongest down; the second goes unless either has gone. The list is one of column names."""
    gone: list[str] = []
    for a, b, r in sorted(pairs, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if abs(r) >= threshold and a not in gone and b not in gone:
            gone.append(b)
    return gone


def all_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(columns, 2))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS or t.startswith("decimal")]


def compare_overlap(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-8) -> DataFrame:
    """For each column that both have: how many rows differ, numbers by a relative tolerance, and up to five example keys."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    numbers = set(numeric_columns(left)) & set(numeric_columns(right))
    b = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in shared])
    joined = left.select(key, *shared).join(b, F.col(key) == F.col("_key"), "full").withColumn("_id", F.coalesce(key, "_key"))

    def differs(c: str):
        x, y = F.col(c), F.col(f"_{c}")
        if c in numbers:
            close = F.abs(x - y) <= F.lit(tolerance) + F.lit(tolerance) * F.abs(y)
            return ~F.coalesce(close, x.isNull() & y.isNull())
        return ~x.cast("string").eqNullSafe(y.cast("string"))

    long = joined.select("_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), differs(c).alias("differs")) for c in shared])).alias("d")).select("_id", "d.*")
    examples = F.slice(F.array_sort(F.collect_list(F.when(F.col("differs") & (F.col("place") <= 5), F.col("_id")))), 1, 5)
    from pyspark.sql import Window

    order = Window.partitionBy("column_name", "differs").orderBy("_id")
    few = long.where("differs").withColumn("place", F.row_number().over(order)).where("place <= 5").groupBy("column_name").agg(examples.alias("examples"))
    counts = long.groupBy("column_name").agg(F.count("*").alias("compared"), F.count(F.when(F.col("differs"), 1)).alias("mismatches"))
    return counts.join(few, "column_name", "left")


def missingness(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row: the greatest share of nulls in a row, and how many columns exceed the threshold of nulls."""
    share = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0)) / len(df.columns)
    many = sum((((F.count("*") - F.count(c)) > threshold * F.count("*")).cast("long") for c in df.columns), F.lit(0))
    return df.agg(F.round(F.max(share), 6).alias("max_row_null_share"), many.cast("long").alias("columns_over"))


def group_sizes(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(*by).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
