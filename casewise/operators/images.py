"""Statistics of small grey images held as flat arrays, row by row; all are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(values).cast("double"))


def brightness(pixels: Column) -> Column:
    return _mean(pixels)


def contrast(pixels: Column) -> Column:
    """Population deviation of the pixels."""
    m = _mean(pixels)
    return F.sqrt(_mean(F.transform(pixels, lambda x: (x.cast("double") - m) * (x.cast("double") - m))))


def edge_strength(pixels: Column, width: int) -> Column:
    """Mean difference of neighbours in a row."""
    steps = F.filter(F.transform(pixels, lambda x, i: F.when(i % width != 0, F.abs(x.cast("double") - F.get(pixels, i - 1).cast("double")))), lambda x: x.isNotNull())
    return _mean(steps)


def region(pixels: Column, width: int, x0: int, x1: int, y0: int, y1: int) -> Column:
    """Mean of the pixels with x0 <= x < x1 and y0 <= y < y1."""
    return _mean(F.filter(pixels, lambda v, i: (i % width >= x0) & (i % width < x1) & (F.floor(i / width) >= y0) & (F.floor(i / width) < y1)))


def symmetry(pixels: Column, width: int) -> Column:
    """1 less the mean difference from the mirror image over twice the mean size of the pixels; null for a black image."""
    mirrored = F.transform(pixels, lambda x, i: F.abs(x.cast("double") - F.get(pixels, i + (width - 1) - 2 * (i % width)).cast("double")))
    return 1 - F.try_divide(_mean(mirrored), 2 * _mean(F.transform(pixels, lambda x: F.abs(x.cast("double")))))


def entropy(pixels: Column, bins: int, low: float, high: float) -> Column:
    """Entropy, in bits, of a histogram of equal bins from low to high; values beyond go to the last ones."""
    step = (high - low) / bins
    places = F.transform(pixels, lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x.cast("double") - low) / step).cast("int"))))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(places, lambda p: p == b)) / F.size(pixels))
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def centroid(pixels: Column, width: int) -> Column:
    """(x, y) of the weight of the absolute values, 0 to 1."""
    weight = F.transform(pixels, lambda x: F.abs(x.cast("double")))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    along = lambda f: F.try_divide(F.aggregate(F.transform(weight, f), F.lit(0.0), lambda s, x: s + x), total)
    return F.array(along(lambda x, i: x * (i % width)) / (width - 1), along(lambda x, i: x * F.floor(i / width)) / (width - 1))
