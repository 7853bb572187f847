"""Two annotators' boxes: comparison by sample, summaries by task, the final table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.geometry import greedy_matches, set_overlap


def compared(a: DataFrame, b: DataFrame, key: str = "sample_id", threshold: float = 0.5) -> DataFrame:
    """One row per sample that either annotator has: counts, labels, matched boxes, overlap of regions, and whether a third person must look.

    Each side has the key, task, status, ``boxes: array<box>`` and ``labels: array<string>``; a missing side has no boxes, and a null array is empty. A key is to be there once a side.
    """
    side = lambda rows, n: rows.select(key, *[F.col(c).alias(f"{c}_{n}") for c in ("task", "status", "boxes", "labels")], F.lit(1).alias(f"present_{n}"))
    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    no_box, no_label = F.array().cast(a.schema["boxes"].dataType), F.array().cast("array<string>")
    fill = lambda c: F.coalesce(c, no_box if c.startswith("boxes") else no_label)
    both = both.withColumns({c: fill(c) for c in ("boxes_a", "boxes_b", "labels_a", "labels_b")})
    types = {f"label_types_{n}": F.array_sort(F.array_distinct(f"labels_{n}")) for n in "ab"}
    both = both.withColumns({**types, "ious": greedy_matches(F.col("boxes_a"), F.col("boxes_b")), "overlap": set_overlap(F.col("boxes_a"), F.col("boxes_b")), "count_a": F.size("boxes_a"), "count_b": F.size("boxes_b")})
    task = F.coalesce(F.nullif("task_a", F.lit("")), F.nullif("task_b", F.lit("")), F.lit(""))
    good = F.size(F.filter("ious", lambda x: x >= threshold))
    same = F.col("label_types_a") == F.col("label_types_b")
    n_a, n_b = F.col("count_a"), F.col("count_b")
    missing = F.col("present_a").isNull() | F.col("present_b").isNull()
    doubt = missing | (n_a != n_b) | ~same | ((n_a > 0) & (good < F.greatest(n_a, n_b))) | ((n_a == 0) & (n_b == 0))
    return both.select(
        key, task.alias("task"), *[F.coalesce(f"status_{n}", F.lit("")).alias(f"status_{n}") for n in "ab"], *[F.coalesce(f"present_{n}", F.lit(0)).alias(f"present_{n}") for n in "ab"],
        n_a.alias("box_count_a"), n_b.alias("box_count_b"), (n_a - n_b).alias("box_count_delta"), *[F.array_join(f"label_types_{n}", ";").alias(f"label_types_{n}") for n in "ab"], same.cast("int").alias("label_type_set_match"),
        F.size("ious").alias("matched_box_pairs"), good.alias("iou_ge_threshold_pairs"), F.when(F.size("ious") > 0, F.aggregate("ious", F.lit(0.0), lambda s, x: s + x) / F.size("ious")).otherwise(0.0).alias("mean_matched_iou"),
        F.coalesce(F.array_min("ious"), F.lit(0.0)).alias("min_matched_iou"), F.col("overlap.iou").alias("union_region_iou"), F.col("overlap.a_in_b").alias("primary_covered_by_secondary"), F.col("overlap.b_in_a").alias("secondary_covered_by_primary"),
        ((n_a == n_b) & (n_a > 0) & (good == n_a)).cast("int").alias("all_boxes_matched_iou"), doubt.cast("int").alias("needs_adjudication"),
    )


#: Means of a summary and the column each is of.
MEANS = {"mean_best_iou": "mean_matched_iou", "mean_union_region_iou": "union_region_iou", "mean_primary_covered_by_secondary": "primary_covered_by_secondary", "mean_secondary_covered_by_primary": "secondary_covered_by_primary"}


def agreement_summary(rows: DataFrame) -> DataFrame:
    """(scope, metric, value) of :func:`compared`, over all and by task; samples without a task count only in all. One grouping over two sets, unpivoted."""
    flag = lambda c: F.sum(c.cast("int")).cast("double")
    counts = {
        "samples": F.count(F.lit(1)).cast("double"), "present_in_both": flag(F.col("present_a") * F.col("present_b")), "box_count_match": flag(F.col("box_count_a") == F.col("box_count_b")),
        **{c: flag(F.col(c)) for c in ("label_type_set_match", "all_boxes_matched_iou", "needs_adjudication")}, **{name: F.avg(c) for name, c in MEANS.items()},
    }
    sums = rows.rollup("task").agg(*[c.alias(n) for n, c in counts.items()], F.grouping_id().alias("_all"))
    long = sums.where("_all = 1 or task <> ''").select(F.when(F.col("_all") == 1, "all").otherwise(F.col("task")).alias("scope"), "_all", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in counts])).alias("m"))
    return long.where("_all = 1 or m.metric <> 'present_in_both'").select("scope", "m.metric", F.coalesce("m.value", F.lit(0.0)).alias("value"))


def final_annotations(consensus: DataFrame, adjudication: DataFrame, allow_unresolved: bool = False, key: str = "sample_id") -> DataFrame:
    """(key, task, boxes, status) from consensus rows (``boxes``) and adjudicated ones (``adjudicated_boxes``).

    A row that nobody has settled (null or empty boxes) is an error when the result is read, or, if allowed, stays with status unresolved and no boxes.
    """
    settled = F.coalesce(F.size("adjudicated_boxes") > 0, F.lit(False))
    boxes = F.when(settled, F.col("adjudicated_boxes")).otherwise(F.slice("adjudicated_boxes", 1, 0) if allow_unresolved else F.raise_error(F.lit("rows without adjudicated boxes")).cast(adjudication.schema["adjudicated_boxes"].dataType))
    agreed = consensus.select(key, "task", "boxes", F.lit("consensus").alias("status"))
    judged = adjudication.select(key, "task", boxes.alias("boxes"), F.when(settled, "adjudicated").otherwise("unresolved").alias("status"))
    return agreed.unionByName(judged)


def external_index(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows once a named key that they have, trimmed and lower-case, as ``key`` = "name=value": the build side of a join on any key; blank keys don't count."""
    made = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{n}="), F.lower(F.trim(c.cast("string"))))) for n, c in keys.items()]
    return rows.select("*", F.explode(F.array_compact(F.array(*made))).alias("key"))
