"""Boxes, zones, colours and layout over element arrays; boxes are arrays (x1, y1, x2, y2), 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import cases_of


def clamped(box: Column) -> Column:
    """Corners in order and within 0 and 1."""
    held = F.transform(box, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double"))))
    return F.array(F.least(held[0], held[2]), F.least(held[1], held[3]), F.greatest(held[0], held[2]), F.greatest(held[1], held[3]))


def quad_to_box(points: Column) -> Column:
    """The box around a flat array of x, y pairs."""
    xs, ys = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])


def overlap(a: Column, b: Column) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 for two empty boxes."""
    shared = overlap(a, b)
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def center(box: Column) -> Column:
    return F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)


def vertical_zone(y: Column, exact: bool = True) -> Column:
    """top, middle or bottom third; the other rule cuts at .33 and .66."""
    a, b = (1 / 3, 2 / 3) if exact else (0.33, 0.66)
    return cases_of((y < a, "top"), (y < b, "middle"), otherwise="bottom")


def horizontal_zone(x: Column, exact: bool = True) -> Column:
    a, b = (1 / 3, 2 / 3) if exact else (0.33, 0.66)
    return cases_of((x < a, "left"), (x < b, "center"), otherwise="right")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h in degrees, s, v) of colours from 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    h = F.when(span == 0, 0.0).when(high == r, F.pmod(60 * (g - b) / F.nullif(span, F.lit(0.0)), F.lit(360.0))).when(high == g, 60 * (b - r) / F.nullif(span, F.lit(0.0)) + 120).otherwise(60 * (r - g) / F.nullif(span, F.lit(0.0)) + 240)
    return F.struct(h.alias("h"), F.when(high == 0, 0.0).otherwise(span / F.nullif(high, F.lit(0.0))).alias("s"), high.alias("v"))


#: Upper bounds of hues in degrees, in order.
HUES = ((15, "red"), (40, "orange"), (70, "yellow"), (160, "green"), (195, "teal"), (255, "blue"), (290, "purple"), (345, "pink"))


def color_name(r: Column, g: Column, b: Column) -> Column:
    c = hsv(r, g, b)
    out = F.when(c["v"] < 0.15, "black").when((c["s"] < 0.10) & (c["v"] > 0.85), "white").when(c["s"] < 0.15, "gray")
    for top, name in HUES:
        out = out.when(c["h"] < top, name)
    return out.otherwise("red")


def zone_counts(boxes: Column) -> dict[str, Column]:
    """How many boxes have their centre in each vertical third."""
    def count(lo: float, hi: float) -> Column:
        return F.size(F.filter(boxes, lambda x: ((x[1] + x[3]) / 2 >= lo) & ((x[1] + x[3]) / 2 < hi)))

    return {"top": count(-1, 1 / 3), "middle": count(1 / 3, 2 / 3), "bottom": count(2 / 3, 9)}


def layout_template(elements: Column) -> dict[str, Column]:
    """How an image's elements are laid out; an element: struct(shape, area, x, y, vertices), areas and centres as shares.

    Elements under .0025 of the area are no cards; round ones among them are pagination dots.
    Cards in two or more rows (centres in the same twentieth of the height) of two or more are
    a grid, cards within .08 of the height a row; a large circle near a large card is a hero.
    """
    cards = F.filter(elements, lambda e: e["area"] >= 0.0025)
    dots = F.size(F.filter(elements, lambda e: (e["area"] < 0.0025) & (e["shape"] == "circle")))
    n = F.size(cards)
    level = F.transform(cards, lambda e: F.floor(e["y"] * 20))
    rows = F.filter(F.transform(F.array_distinct(level), lambda b: F.size(F.filter(level, lambda x: x == b))), lambda k: k >= 2)
    grid = (n >= 4) & (F.size(rows) >= 2)
    ys = F.transform(cards, lambda e: e["y"])
    row = (n >= 2) & (F.array_max(ys) - F.array_min(ys) < 0.08)
    large = F.filter(cards, lambda e: e["area"] > 0.02)
    near = lambda a, b: (F.abs(a["x"] - b["x"]) < 0.3) & (F.abs(a["y"] - b["y"]) < 0.2)
    hero = F.exists(large, lambda c: (c["shape"] == "circle") & F.exists(large, lambda r: r["shape"].contains("card") & near(c, r)))
    template = F.when(grid, F.concat(F.lit("grid_"), F.size(rows).cast("string"), F.lit("x"), F.array_max(rows).cast("string"))).when(row & (n >= 3), "carousel_3").when(row & (n == 2), "dual_product")
    template = template.when(hero, "hero_shapes").when(n == 1, "single_product").when(n == 0, "minimal").otherwise(F.concat(F.lit("multi_product_"), n.cast("string")))
    arrow = F.exists(elements, lambda e: (e["x"] > 0.8) & (e["area"] > 0.002) & (e["area"] < 0.03) & (F.coalesce(e["vertices"], F.lit(0)) <= 5) & e["shape"].isin("shape", "card_portrait"))
    return {"layout_template": template, "product_card_count": n, "pagination_dot_count": dots, "has_pagination_dots": dots >= 2, "has_grid_layout": grid, "has_carousel_indicator": arrow}


def whitespace_balance(used: Column) -> Column:
    """1 at .38 of the area empty, falling to 0 with the distance from it."""
    return F.greatest(F.lit(0.0), 1 - F.abs((1 - used) - 0.38) / 0.38)
