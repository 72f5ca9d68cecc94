"""Columns by name and type: prefixes, roles, flattening, scaling, dictionaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import safe_div

#: Roles by prefix, the first that fits.
ROLES = (("first_", "early_window"), ("lifecycle_", "lifecycle"), ("overall_", "outcome"), ("vis_", "visual"), ("prompt_", "layout"), ("is_", "flag"), ("has_", "flag"))


def prefixed(df: DataFrame, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    """All but the keys get a prefix; columns that end in a number come in its order."""
    def place(c: str):
        tail = re.search(r"(\d+)$", c)
        return (c[: tail.start()], int(tail[1])) if tail else (c, -1)

    rest = sorted((c for c in df.columns if c not in keys), key=place)
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in rest])


def role(name: str, kind: str) -> str:
    """What a column is for, by its name, else by its type."""
    if name.endswith(("_id", "key")):
        return "identifier"
    for prefix, r in ROLES:
        if name.startswith(prefix):
            return r
    return "text" if kind == "string" else "time" if kind.startswith(("date", "timestamp")) else "number"


def column_dictionary(df: DataFrame, spark) -> DataFrame:
    """(column_name, data_type, role) of a table's columns."""
    return spark.createDataFrame([(c, t, role(c, t)) for c, t in df.dtypes], "column_name string, data_type string, role string")


def flattened(df: DataFrame, column: str, paths: dict[str, tuple[str, str, object]]) -> DataFrame:
    """Values of a JSON column as columns. paths: name -> (JSON path, type, default); booleans become 0 or 1."""
    def one(path: str, kind: str, default: object) -> Column:
        raw = F.get_json_object(column, path)
        value = (F.lower(raw) == "true").cast("int") if kind == "boolean" else raw.try_cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast("int" if kind == "boolean" else kind))

    return df.withColumns({name: one(*p) for name, p in paths.items()})


def id_of(text: Column) -> Column:
    """The number that a text ends in; null if it doesn't."""
    return F.regexp_extract(text.cast("string"), r"(\d+)$", 1).try_cast("bigint")


def shares(df: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """(by, mix): the share of each value of a column in its group, to 4 places, as a map."""
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("key"), "n"))).alias("all"))
    return total.select(*by, F.map_from_entries(F.transform("all", lambda x: F.struct(x["key"], F.round(x["n"] / F.col("total"), 4)))).alias("mix"))


def describe(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each number: count, mean, deviation, least, quartiles, greatest; one pass."""
    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.round(F.avg(x), 5).alias("mean"), F.round(F.stddev_samp(x), 5).alias("deviation"), F.min(x).alias("least"), F.round(q[0], 5).alias("p25"), F.round(q[1], 5).alias("p50"), F.round(q[2], 5).alias("p75"), F.max(x).alias("greatest"))

    return df.agg(F.array(*map(stats, columns)).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def most_frequent(df: DataFrame, columns: tuple[str, ...], n: int = 5) -> DataFrame:
    """(column_name, value, n, place): the n most frequent values of each column; ties to the lesser."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    counts = long.where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def entropy(df: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """Shannon entropy, in bits, of a column's values in each group."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return total.select(*by, F.round(F.log2("total") - safe_div(F.col("weighted"), F.col("total")), 6).alias("entropy"))


def sequence_audit(df: DataFrame, entity: str, order: str, column: str, source: str, width: int = 3) -> DataFrame:
    """One row: how often a column equals the running sum of the ``width`` earlier rows, of those and this one, or the row before."""
    from pyspark.sql import Window

    w = Window.partitionBy(entity).orderBy(order)
    earlier = F.coalesce(F.sum(source).over(w.rowsBetween(-width, -1)), F.lit(0))
    upto = F.coalesce(F.sum(source).over(w.rowsBetween(-width + 1, 0)), F.lit(0))
    before = F.coalesce(F.lag(source).over(w), F.lit(0))
    marked = df.select(*[(F.col(column) == x).cast("double").alias(n) for n, x in (("earlier", earlier), ("upto", upto), ("before", before))])
    return marked.agg(*[F.round(F.avg(c), 6).alias(f"{c}_share") for c in ("earlier", "upto", "before")])
