"""Column expressions shared by the operators; all null-safe under ANSI mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """num / den; null where den is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held within lo and hi; a null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def rounded(x: Column, digits: int) -> Column:
    """x * 10^digits to the nearest whole number, halves away from 0, over 10^digits: what SQL's round on doubles gives.

    Spark's own round takes the shortest decimal that names the double, so 41 / 640 (0.0640625, a
    little less times a million) goes up there. Numbers too large to have such digits stay.
    """
    scale = float(10**digits)
    y = F.abs(x) * scale
    down = F.floor(y).cast("double")
    return F.when(y < 2.0**52, F.signum(x) * (down + F.when(y - down >= 0.5, 1.0).otherwise(0.0)) / scale).otherwise(x)


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def micros(x: Column) -> Column:
    """A money amount in ten-thousandths, so that sums don't depend on their order."""
    return F.round(x * 10000).cast("long")


def cases_of(*branches: tuple[Column, str], otherwise: str) -> Column:
    """The value of the first branch whose condition holds."""
    out = F.when(*branches[0])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: weights of null values don't count; the plain mean where weights sum to 0 or less."""
    used = F.sum(F.when(value.isNotNull(), weight))
    return F.when(used > 0, F.sum(value * weight) / used).otherwise(F.avg(value))


def same_known(query: Column, other: Column) -> Column:
    """True only where the query's value is present and equal."""
    return F.coalesce(query == other, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean norm; 1 in place of 0 or a non-finite one."""
    n = F.sqrt(dot(a, a))
    return F.when((n > 0) & finite(n).isNotNull(), n).otherwise(F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalize_text(x: Column) -> Column:
    """Lower case without Latin accents, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), _ACCENTED, _PLAIN), r"\s+", " "))


def normalize_ascii(x: Column, keep: str = "a-z0-9%$€£¥") -> Column:
    """Lower case; every run of other than ``keep`` is one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), f"[^{keep}]+", " "))


def flag(x: Column) -> Column:
    """A lenient boolean: 1, true, yes, y or a number other than 0; null is false."""
    text = F.lower(F.trim(x.cast("string")))
    return F.coalesce(text.isin("1", "true", "yes", "y") | F.coalesce(text.try_cast("double") != 0, F.lit(False)), F.lit(False))


def agreement(scores: Column) -> Column:
    """Mean of the clipped block scores, lowered by their spread (population deviation of the clipped, 1 at most); nulls don't count."""
    held = F.transform(F.array_compact(scores), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    n = F.nullif(F.size(held), F.lit(0))
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(held, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.coalesce(mean * (1 - F.least(spread, F.lit(1.0))), F.lit(0.0))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def register_functions(spark: SparkSession) -> None:
    """SQL names of the main expressions, as SQL functions (no Python at run time)."""
    for body in (
        "cw_safe_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN try_divide(a, b)",
        "cw_clip(x DOUBLE, lo DOUBLE, hi DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END",
        f"cw_normalize_text(x STRING) RETURNS STRING RETURN trim(regexp_replace(translate(lower(x), '{_ACCENTED}', '{_PLAIN}'), '\\\\s+', ' '))",
        "cw_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
