"""Boxes ``struct<x1,y1,x2,y2:double>`` and arrays of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def normalised(b: Column, width: Column, height: Column) -> Column:
    """Pixel boxes (any coordinate beyond 1.5) scaled, clipped to 0..1, corners ordered; null where no area is left."""
    pixel = F.greatest(*[F.abs(b[c]) for c in ("x1", "y1", "x2", "y2")]) > 1.5
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    x = [clip(F.when(pixel, b[c] / width).otherwise(b[c])) for c in ("x1", "x2")]
    y = [clip(F.when(pixel, b[c] / height).otherwise(b[c])) for c in ("y1", "y2")]
    # bound, as inside of a lambda each use of an expression computes it anew
    return bound(F.struct(x[0].alias("a"), x[1].alias("b"), y[0].alias("c"), y[1].alias("d")), lambda s: F.when((s["a"] != s["b"]) & (s["c"] != s["d"]), box(F.least(s["a"], s["b"]), F.least(s["c"], s["d"]), F.greatest(s["a"], s["b"]), F.greatest(s["c"], s["d"]))))


def distinct_boxes(boxes: Column) -> Column:
    """First of the boxes that agree to a millionth."""
    key = lambda b: F.concat_ws(",", *[F.bround(b[c] * 1e6).cast("long").cast("string") for c in ("x1", "y1", "x2", "y2")])
    firsts = lambda bs, keys: F.filter(bs, lambda b, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return bound(boxes, lambda bs: bound(F.transform(bs, key), lambda keys: firsts(bs, keys)))


def holds_centre(b: Column, region: Column) -> Column:
    x, y = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return (x >= region["x1"]) & (x <= region["x2"]) & (y >= region["y1"]) & (y <= region["y2"])


def centre_recall(regions: Column, kept: Column) -> Column:
    """The share of regions that hold the centre of a kept box."""
    hit = F.filter(regions, lambda r: F.exists(kept, lambda k: holds_centre(k, r)))
    return F.when(F.size(regions) > 0, F.size(hit) / F.size(regions)).otherwise(0.0)


def touched(tokens: Column, regions: Column) -> Column:
    """0-based numbers of the tokens that overlap a region."""
    marked = F.transform(tokens, lambda t, i: F.when(F.exists(regions, lambda r: overlap(t, r) > 0), i))
    return F.filter(marked, lambda i: i.isNotNull())


def patch_recall(tokens: Column, regions: Column, kept: Column) -> Column:
    hit = touched(tokens, regions)
    return F.when(F.size(hit) > 0, F.size(F.array_intersect(hit, kept)) / F.size(hit)).otherwise(0.0)


def mean_best_iou(a: Column, b: Column) -> Column:
    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: iou(x, y))), F.lit(0.0)))
    return F.when(F.size(a) > 0, F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(0.0)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: a lambda's variable, where the expression itself would be computed at each of its uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def union_area(boxes: Column) -> Column:
    """Exact area of a union: over the strips between neighbouring x edges, merged y intervals of the boxes that cover the strip."""
    edges = lambda solid: F.array_sort(F.array_distinct(F.concat(F.transform(solid, lambda b: b["x1"]), F.transform(solid, lambda b: b["x2"]))))

    def covered(solid: Column, x1: Column, x2: Column) -> Column:
        spans = F.transform(F.filter(solid, lambda b: (b["x1"] <= x1) & (b["x2"] >= x2)), lambda b: F.struct(b["y1"].alias("lo"), b["y2"].alias("hi")))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("top"))
        step = lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0.0), s["hi"] - F.greatest(s["lo"], a["top"]))).alias("sum"), F.greatest(a["top"], s["hi"]).alias("top"))
        return F.aggregate(spans, start, step)["sum"]

    def strips(solid: Column, xs: Column) -> Column:
        right = F.slice(xs, F.lit(2), F.greatest(F.lit(0), F.size(xs) - 1))
        return F.transform(right, lambda x2, i: (x2 - F.get(xs, i)) * covered(solid, F.get(xs, i), x2))

    # boxes in the order of their lower edges, so that a strip's spans are in order as they are found
    by_y = F.array_sort(F.transform(F.filter(boxes, lambda b: area(b) > 0), lambda b: F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), b["x1"].alias("x1"), b["x2"].alias("x2"))))
    whole = bound(by_y, lambda solid: bound(edges(solid), lambda xs: F.aggregate(strips(solid, xs), F.lit(0.0), lambda s, x: s + x)))
    return F.coalesce(whole, F.lit(0.0))


def clipped(boxes: Column, regions: Column) -> Column:
    """Every non-empty overlap of a box with a region."""
    cut = lambda a, b: box(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))
    every = F.flatten(F.transform(boxes, lambda a: F.transform(regions, lambda r: F.when(overlap(a, r) > 0, cut(a, r)))))
    return F.filter(every, lambda b: b.isNotNull())


def evidence_coverage(kept: Column, evidence: Column) -> Column:
    """The share of the evidence's union that kept boxes cover; 0 without evidence or kept boxes."""
    share = lambda whole: F.when(whole > 0, F.least(F.lit(1.0), union_area(clipped(kept, evidence)) / whole)).otherwise(0.0)
    return bound(union_area(evidence), share)


def token_grid(rows: int, columns: int) -> Column:
    """Boxes of a grid, row by row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda x: box(x / columns, y / rows, (x + 1) / columns, (y + 1) / rows))))
