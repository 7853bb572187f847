"""Kept-token masks and boxes: geometry, variants, perturbations, random regions; guards of aligned runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions import boxes as bx
from evalweave.functions.hashing import key_seeds, replicate_uniform, uniform
from evalweave.operators.joins import refuse


def gaps(indices: Column) -> Column:
    """Differences of neighbouring sorted indices."""
    s, n = F.array_sort(indices), F.greatest(F.lit(0), F.size(indices) - 1)
    return F.zip_with(F.slice(s, F.lit(2), n), F.slice(s, F.lit(1), n), lambda b, a: b - a)


def runs(indices: Column) -> Column:
    """How many stretches of neighbouring indices there are."""
    return F.when(F.size(indices) == 0, 0).otherwise(1 + F.size(F.filter(gaps(indices), lambda g: g > 1)))


def spread(indices: Column, total: Column, parts: int = 10) -> list[Column]:
    """Span, covered tenths and entropy over tenths of a mask."""
    part = F.transform(indices, lambda i: F.least(F.lit(parts - 1), F.floor(i * parts / total)).cast("int"))
    share = F.filter(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.size(F.filter(part, lambda q: q == p)) / F.size(part)), lambda s: s > 0)
    some = F.size(indices) > 0
    entropy = F.aggregate(share, F.lit(0.0), lambda a, s: a - s * F.ln(s))
    return [
        F.when(some, (F.array_max(indices) - F.array_min(indices) + 1) / total).otherwise(0.0).alias("span"), F.when(some, F.size(F.array_distinct(part)) / parts).otherwise(0.0).alias("covered"),
        F.when(some, entropy / F.ln(F.lit(float(parts)))).otherwise(0.0).alias("entropy"),
    ]


def deletion_variants(rows: DataFrame, sample: str, kept: str, evidence: str, total: str, seed: int = 0) -> DataFrame:
    """(variant, indices): the mask; without its evidence; without as many other tokens; with the missing evidence; with as many other tokens, chosen by hash."""
    every = F.sequence(F.lit(0), F.col(total) - 1)
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda i: F.struct(uniform(seed, F.col(sample), i).alias("u"), i.alias("i")))), lambda s: s["i"])
    inside, outside = F.array_intersect(kept, evidence), F.array_except(kept, evidence)
    missing, spare = F.array_except(evidence, kept), F.array_except(every, F.array_union(F.col(kept), F.col(evidence)))
    pick = lambda a, n: F.slice(order(a), F.lit(1), n)
    made = {
        "selected": F.col(kept), "delete_evidence": F.array_except(kept, evidence), "delete_control": F.array_except(F.col(kept), pick(outside, F.size(inside))),
        "restore_evidence": F.array_union(F.col(kept), missing), "restore_control": F.array_union(F.col(kept), pick(spare, F.size(missing))),
    }
    parts = F.array(*[F.struct(F.lit(n).alias("variant"), F.array_sort(a).alias("indices")) for n, a in made.items()])
    return rows.select(sample, F.explode(parts).alias("v")).select(sample, "v.*")


def perturbed(box: Column, key: Column, jitter: float, scale: float, seed: int = 0, drop: float = 0.0) -> Column:
    """A box moved by up to ``jitter`` of its size and scaled by 1 +- ``scale``, by hashed numbers, within 0..1; null, as if it hadn't been found, for a share ``drop`` of the keys, and where no area is left."""
    u = lambda name: uniform(seed, key, name) * 2 - 1
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    cx, cy = (box["x1"] + box["x2"]) / 2 + u("x") * jitter * w, (box["y1"] + box["y2"]) / 2 + u("y") * jitter * h
    w, h = w * (1 + u("w") * scale) / 2, h * (1 + u("h") * scale) / 2
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    out = bx.box(clip(cx - w), clip(cy - h), clip(cx + w), clip(cy + h))
    return F.when((uniform(seed, key, "drop") >= drop) & (bx.area(out) > 0), out)


def random_region(rows: DataFrame, sample: str, box: str, most: float = 0.1, tries: int = 200, seed: int = 0) -> DataFrame:
    """A box of the same size elsewhere: the first try whose IoU is small enough, else the try of least IoU.

    Tries are made a few at a time, as most rows need one or two; later ones are evaluated only where those before have failed.
    """
    b = F.col(box)
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    # column by column, so that each hashed number is made once
    first, second = key_seeds(seed, F.col(sample))
    tried = rows.withColumn("_a", first).withColumn("_b", second)
    number = lambda k: replicate_uniform(F.col("_a"), F.col("_b"), k)

    def made(lo: int, hi: int) -> Column:
        places = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.struct(k.alias("k"), (number(k * 2) * (1 - w)).alias("x"), (number(k * 2 + 1) * (1 - h)).alias("y")))
        regions = F.transform(places, lambda s: F.struct(s["k"].alias("k"), bx.box(s["x"], s["y"], s["x"] + w, s["y"] + h).alias("region")))
        return F.transform(regions, lambda s: F.struct(bx.iou(s["region"], b).alias("iou"), s["k"].alias("k"), s["region"].alias("region")))

    ends = [e for e in (0, 2, 8, 32) if e < tries] + [tries]
    fine = [F.get(F.filter(made(lo + 1, hi), lambda m: m["iou"] <= most), F.lit(0)) for lo, hi in zip(ends, ends[1:], strict=False)]
    tried = tried.withColumn("_m", F.coalesce(*fine, F.array_min(made(1, tries))))
    return tried.select(*rows.columns, F.col("_m.region").alias("region"), F.col("_m.iou").alias("region_iou"))


def spatial_overlaps(boxes: DataFrame, regions: DataFrame, key: str, box_id: str, region_id: str, cells: int = 8) -> DataFrame:
    """Pairs of a box and a region of one key that overlap: both are put on the cells of a grid they touch, so that it is an equi-join."""
    def gridded(df: DataFrame, own: str, box: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.greatest(F.lit(0), F.floor(F.col(f"{box}.{lo}") * cells).cast("int")), F.least(F.lit(cells - 1), F.floor(F.col(f"{box}.{hi}") * cells).cast("int")))
        return df.select(key, own, box, F.explode(span("x1", "x2")).alias("_cx")).select("*", F.explode(span("y1", "y2")).alias("_cy"))

    a, b = gridded(boxes.withColumnRenamed("box", "_a"), box_id, "_a"), gridded(regions.withColumnRenamed("box", "_b"), region_id, "_b")
    hit = a.join(b, [key, "_cx", "_cy"]).select(key, box_id, region_id, bx.overlap(F.col("_a"), F.col("_b")).alias("area")).where("area > 0")
    return hit.distinct()


def local_uniqueness(tokens: DataFrame, sample: str, row: str, column: str, vector: str) -> DataFrame:
    """Mean of 1 - cosine to the neighbours left, right, above and below."""
    from evalweave.functions.maths import cosine

    across, down = Window.partitionBy(sample, row).orderBy(column), Window.partitionBy(sample, column).orderBy(row)
    near = [f(vector).over(w) for w in (across, down) for f in (F.lag, F.lead)]
    out = tokens.withColumn("_near", F.filter(F.array(*near), lambda v: v.isNotNull()))
    total = F.aggregate(F.transform("_near", lambda v: 1 - cosine(F.col(vector), v)), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("uniqueness", F.when(F.size("_near") > 0, total / F.size("_near")).otherwise(0.0)).drop("_near")


def replay_mismatches(left: DataFrame, right: DataFrame, order: str, identifier: str, kept: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Two replays aligned by place: ids must agree, differences of masks and values are counted."""
    a = left.select(order, F.col(identifier).alias("_ia"), F.col(kept).alias("_ka"), F.col(value).alias("_va"))
    b = right.select(order, F.col(identifier).alias("_ib"), F.col(kept).alias("_kb"), F.col(value).alias("_vb"))
    both = a.join(b, order, "full_outer")
    refuse(both.where("not (_ia <=> _ib)"), "the replays hold different ids")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ka").eqNullSafe(F.col("_kb"))).alias("masks_differ"), F.count_if(F.coalesce(F.abs(F.col("_va") - F.col("_vb")) > tolerance, F.lit(False))).alias("values_differ"))


def require_blank(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; an error if a protected column holds anything."""
    for c in columns:
        refuse(rows.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""), f"{c} must be blank")
    return rows


def grid_of(tokens: Column, aspect: Column) -> Column:
    """The factor pair (rows, columns) of the token count whose shape is nearest to width / height."""
    pairs = F.transform(F.filter(F.sequence(F.lit(1), tokens), lambda r: tokens % r == 0), lambda r: F.struct(F.abs(F.ln((tokens / r) / r) - F.ln(aspect)).alias("d"), r.alias("rows"), (tokens / r).cast("int").alias("columns")))
    best = F.array_min(pairs)
    return F.struct(best["rows"].alias("rows"), best["columns"].alias("columns"))


def pixel_box(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels, half to even, at least one wide and high, inside the image."""
    x1 = F.greatest(F.lit(0), F.least(width - 1, F.bround(b["x1"] * width).cast("int")))
    y1 = F.greatest(F.lit(0), F.least(height - 1, F.bround(b["y1"] * height).cast("int")))
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1 + 1, F.least(width, F.bround(b["x2"] * width).cast("int"))).alias("x2"), F.greatest(y1 + 1, F.least(height, F.bround(b["y2"] * height).cast("int"))).alias("y2"))


#: Tokens that one word of a bitmap holds.
WORD = 64


def bitmaps(kept: DataFrame, by: list[str], index: str) -> DataFrame:
    """(by, word, bits): the indices of each mask as words of a bitmap; words without an index have no row."""
    return kept.groupBy(*by, F.floor(F.col(index) / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(`{index}` % {WORD}))")).alias("bits"))


def mask_shape(kept: DataFrame, by: list[str], index: str, total: Column, parts: int = 10) -> DataFrame:
    """(by, kept, mean_index, std_index, span, gap_mean, gap_max, runs, entropy, covered, edge, centre) of each mask, from one ordered pass; indices count from 0 to ``total`` - 1, as shares of total - 1.

    Entropy is over tenths, in units of the largest; edge and centre are the shares of indices in the outer tenths and the middle fifth.
    """
    rows = kept.select(*by, F.col(index).alias("_i"), total.alias("_n")).where("_i >= 0 and _i < _n").distinct()
    gap = F.col("_i") - F.lag("_i").over(Window.partitionBy(*by).orderBy("_i"))
    denom = F.greatest(F.lit(1), F.col("_n") - 1)
    rows = rows.withColumns({"_gap": gap, "_at": F.col("_i") / denom, "_part": F.least(F.lit(parts - 1), F.floor(F.col("_i") * parts / F.col("_n"))).cast("int"), "_denom": denom})
    tenths = [F.count_if(F.col("_part") == p) for p in range(parts)]
    every = F.count(F.lit(1))
    entropy = sum((F.when(t > 0, -(t / every) * F.ln(t / every + 1e-12)).otherwise(0.0) for t in tenths[1:]), F.when(tenths[0] > 0, -(tenths[0] / every) * F.ln(tenths[0] / every + 1e-12)).otherwise(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*by).agg(
        every.alias("kept"), F.avg("_at").alias("mean_index"), F.stddev_pop("_at").alias("std_index"), ((F.max("_i") - F.min("_i")) / F.max("_denom")).alias("span"), zero(F.avg(F.col("_gap") / F.col("_denom"))).alias("gap_mean"),
        zero(F.max(F.col("_gap") / F.col("_denom"))).alias("gap_max"), (F.count_if(F.col("_gap") > 1) + 1).alias("runs"), (entropy / F.ln(F.lit(float(parts)))).alias("entropy"), (sum((t > 0).cast("int") for t in tenths) / parts).alias("covered"),
        F.avg(((F.col("_at") <= 0.10) | (F.col("_at") >= 0.90)).cast("double")).alias("edge"), F.avg(F.col("_at").between(0.40, 0.60).cast("double")).alias("centre"),
    )


def cross_budget_features(kept: DataFrame, sample: str, budget: str, index: str, total: Column, budgets: list[float]) -> DataFrame:
    """A row per sample: how its masks at rising ``budgets`` (three) differ: Jaccard similarities, shares of new indices, gains of entropy, and changes of the edge and centre shares from the first to the last.

    Masks are bitmaps: a sample and word has one row with the words of all budgets, and sets are counted as bits. A sample without a mask at some budget has an empty one there.
    """
    low, mid, high = budgets
    words = bitmaps(kept.where(F.col(budget).isin(budgets)), [sample, budget], index)
    at = {n: F.coalesce(F.max(F.when(F.col(budget) == b, F.col("bits"))), F.lit(0).cast("long")).alias(n) for n, b in (("l", low), ("m", mid), ("h", high))}
    words = words.groupBy(sample, "word").agg(*at.values())
    count = lambda e: F.sum(F.bit_count(e)).cast("long")
    both, either = lambda a, b: F.col(a).bitwiseAND(F.col(b)), lambda a, b: F.col(a).bitwiseOR(F.col(b))
    jaccard = lambda a, b: (count(both(a, b)) / F.greatest(F.lit(1), count(either(a, b))))
    fresh = lambda a, b: F.coalesce((count(F.col(b)) - count(both(a, b))) / F.nullif(count(F.col(b)), F.lit(0).cast("long")), F.lit(0.0))
    sets = words.groupBy(sample).agg(jaccard("l", "m").alias("jaccard_low_mid"), jaccard("m", "h").alias("jaccard_mid_high"), jaccard("l", "h").alias("jaccard_low_high"), fresh("l", "m").alias("new_low_mid"), fresh("m", "h").alias("new_mid_high"))
    shapes = mask_shape(kept.where(F.col(budget).isin(budgets)), [sample, budget], index, total)
    of = lambda b, c: F.coalesce(F.max(F.when(F.col(budget) == b, F.col(c))), F.lit(0.0))
    moved = shapes.groupBy(sample).agg(
        (of(mid, "entropy") - of(low, "entropy")).alias("entropy_gain_low_mid"), (of(high, "entropy") - of(mid, "entropy")).alias("entropy_gain_mid_high"), (of(high, "edge") - of(low, "edge")).alias("edge_delta"), (of(high, "centre") - of(low, "centre")).alias("centre_delta"),
    )
    return sets.join(moved, sample)
