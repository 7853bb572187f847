"""Token selection that reads vectors, as plans: anchors whose number the data decide, expansion by importance and novelty, and contextual merging with lineage.

A sample's tokens (some thousands) are the unit: windows and joins run by sample, and arrays hold one sample's tokens at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.boxes import bound
from evalweave.functions.maths import dot

NEVER = -1e9


def unit(v: Column) -> Column:
    """The vector at length 1; a vector without length stays as it is."""
    v = v.cast("array<double>")
    return bound(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def adaptive_anchors(tokens: DataFrame, sample: str, index: str, relevance: str, vec: str, keep: Column, k_min: int, tau: float = 0.2, patience: int = 3, most: float = 0.5) -> DataFrame:
    """(sample, index, place) of each sample's anchors, the most relevant first, ties by index.

    At least ``k_min`` are anchors. Further tokens down to the share ``most`` of the budget join until ``patience`` of them are new: their distance from the nearest of the first k_min is above ``tau``; the last of those ends the anchors. ``keep`` is the budget, over n, the sample's tokens.
    """
    whole = Window.partitionBy(sample)
    rows = tokens.select(sample, index, F.col(relevance).alias("_r"), unit(F.col(vec)).alias("_u"), F.count(F.lit(1)).over(whole).alias("n"))
    rows = rows.withColumns({"place": F.row_number().over(whole.orderBy(F.col("_r").desc(), index)), "_k": F.least(F.col("n"), keep)}).where("_k > 0")
    rows = rows.withColumn("_low", F.least(F.greatest(F.lit(1), F.lit(k_min)), F.col("_k"))).withColumn("_high", F.least(F.greatest("_low", F.floor(F.col("_k") * most)), F.col("_k")))
    first = rows.where("place <= _low").groupBy(sample).agg(F.collect_list("_u").alias("_anchors"))  # k_min vectors
    seen = rows.where("place <= _high").join(first, sample)
    new = (F.col("place") > F.col("_low")) & (1 - F.array_max(F.transform("_anchors", lambda a: dot(F.col("_u"), a))) > tau)
    before = Window.partitionBy(sample).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_new", new.cast("int")).withColumn("_before", F.coalesce(F.sum("_new").over(before), F.lit(0)))
    return seen.where(F.col("_before") < max(1, patience)).select(sample, index, "place")


def expand_by_importance(tokens: DataFrame, anchors: DataFrame, sample: str, index: str, vec: str, importance: str, keep: Column) -> DataFrame:
    """(sample, index, is_anchor) of ``keep`` tokens of each sample: its anchors, by place, then one by one the token of the largest importance times distance from all picked ones, ties by index.

    Importance counts from 0 up. Without anchors the most important token comes first. Each pick depends on those before: a fold over the sample's array.
    """
    rows = tokens.join(anchors.select(sample, index, "place"), [sample, index], "left")
    own = F.struct(F.col(index).alias("i"), unit(F.col(vec)).alias("u"), F.greatest(F.lit(0.0), F.col(importance).cast("double")).alias("w"), "place")
    rows = rows.groupBy(sample).agg(F.array_sort(F.collect_list(own)).alias("_t")).withColumn("n", F.size("_t")).withColumn("_k", F.least(F.col("n"), keep).cast("int")).where("_k > 0")
    free = lambda t: t["place"].isNull() | (t["place"] > F.col("_k"))
    best = lambda scores: F.array_position(scores, F.array_max(scores)).cast("int")
    given = F.transform("_t", lambda t: F.coalesce(t["place"] <= F.col("_k"), F.lit(False)))
    start = F.when(F.exists("_given", lambda g: g), F.col("_given")).otherwise(F.transform("_t", lambda t, i: i + 1 == best(F.col("_t.w"))))
    rows = rows.withColumn("_given", given).withColumn("_picked", start)
    distance = lambda t, of: F.coalesce(F.array_min(F.transform(of, lambda o: 1 - dot(t["u"], o["u"]))), F.lit(1.0))
    rows = rows.withColumn("_first", F.filter("_t", lambda t, i: F.get("_picked", i)))
    near = F.transform("_t", lambda t, i: F.when(F.get("_picked", i), NEVER).otherwise(F.least(F.lit(1.0), distance(t, F.col("_first")))))
    rows = rows.withColumn("_near", near)
    scores = lambda near: F.zip_with(near, F.col("_t.w"), lambda d, w: F.when(d == NEVER, NEVER).otherwise(d * w))
    after = lambda near, j: F.transform(near, lambda d, i: F.when((i + 1 == j) | (d == NEVER), NEVER).otherwise(F.least(d, 1 - dot(F.get("_t", i)["u"], F.get("_t", j - 1)["u"]))))
    steps = F.col("_k") - F.size("_first")
    turns = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(turns, F.col("_near"), lambda near, _: bound(best(scores(near)), lambda j: after(near, j)))
    rows = rows.withColumn("_last", last)
    kept = F.filter(F.transform("_t", lambda t, i: F.struct(t["i"].alias(index), F.coalesce(F.get("_given", i), F.lit(False)).alias("is_anchor"), (F.get("_last", i) == NEVER).alias("_kept"))), lambda s: s["_kept"])
    return rows.select(sample, F.inline(kept)).drop("_kept")


def budget_split(keep: Column) -> Column:
    """struct<dominant, contextual>: ten of 64 kept tokens are contextual, at least one; none of two or fewer."""
    contextual = F.when(keep <= 2, 0).otherwise(F.least(keep - 1, F.greatest(F.lit(1), F.bround(keep * 10 / 64)))).cast("int")
    return F.struct((keep - contextual).cast("int").alias("dominant"), contextual.alias("contextual"))


def contextual_merge(tokens: DataFrame, sample: str, index: str, saliency: str, metric: str, feature: str, keep: Column) -> DataFrame:
    """(sample, index, role, merged, vec): the kept tokens of each sample, the indices that each stands for besides itself, and its vector.

    Dominant tokens are the most salient (ties by index) and stay as they are. Of the rest, in order, every step-th is contextual; all others go to the contextual token of the most similar ``metric`` (the first among equals), whose ``feature`` grows by the mean of theirs.
    A sample whose budget holds all of its tokens keeps them. ``keep`` is over n, the sample's tokens.
    """
    whole = Window.partitionBy(sample)
    rows = tokens.select(sample, index, F.col(saliency).alias("_s"), unit(F.col(metric)).alias("_u"), F.col(feature).cast("array<double>").alias("vec"), F.count(F.lit(1)).over(whole).alias("n"))
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.least(F.col("n"), keep)).cast("int")).withColumn("_b", budget_split(F.col("_k")))
    rows = rows.withColumn("_place", F.row_number().over(whole.orderBy(F.col("_s").desc(), index)))
    rows = rows.withColumn("_dominant", (F.col("_k") >= F.col("n")) | (F.col("_place") <= F.col("_b.dominant")))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(sample, "_dominant").orderBy(index)) - 1)
    step = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("_b.dominant")) / F.greatest(F.lit(1), F.col("_b.contextual"))))
    centre = ~F.col("_dominant") & (F.col("_at") % step == 0) & (F.floor(F.col("_at") / step) < F.col("_b.contextual"))
    rows = rows.withColumn("role", F.when(F.col("_dominant"), "dominant").when(centre, "contextual").otherwise("merged"))
    centres = rows.where("role = 'contextual'").groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col("_u").alias("u")))).alias("_centres"))
    left = rows.where("role = 'merged'").join(centres, sample)
    alike = F.transform("_centres", lambda c: dot(F.col("_u"), c["u"]))
    left = left.withColumn("_alike", alike).withColumn("_to", F.get(F.col("_centres.i"), F.array_position("_alike", F.array_max("_alike")).cast("int") - 1))
    parts = left.select(sample, F.col("_to").alias(index), F.posexplode("vec").alias("_d", "_x")).groupBy(sample, index, "_d").agg(F.avg("_x").alias("_x"))
    means = parts.groupBy(sample, index).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("_mean"))
    lineage = left.groupBy(sample, F.col("_to").alias("_i")).agg(F.sort_array(F.collect_list(index)).alias("merged")).withColumnRenamed("_i", index)
    kept = rows.where("role <> 'merged'").join(lineage, [sample, index], "left").join(means, [sample, index], "left")
    grown = F.when(F.col("_mean").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_mean", lambda a, b: a + b))
    return kept.select(sample, index, "role", F.coalesce("merged", F.array().cast(f"array<{dict(tokens.dtypes)[index]}>")).alias("merged"), grown.alias("vec"))
