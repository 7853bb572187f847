"""Runs, their traces and probes joined by sample: checks, backfill, budgets, comparisons of arms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.features import answer_words, decoy_edit, decoy_length, shape_classes
from evalweave.functions.geometry import local_precision
from evalweave.functions.boxes import area, centre_recall, evidence_coverage, patch_recall, union_area
from evalweave.functions.maths import harmonic, removal_fraction
from evalweave.operators.resampling import DRAWS, weighted, weighted_mean
from evalweave.operators.joins import refuse


def failing(condition: Column, message: str, otherwise: Column) -> Column:
    """``otherwise``, or an error when the result is read where the condition holds."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("double")).otherwise(otherwise)


def cluster_differences(left: DataFrame, right: DataFrame, key: str, cluster: str, value: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """(cluster, n, mean) of a value of each left row and the right row of its key.

    ``value`` gets two functions from a column name to that side's column; null values don't count. A left row without a partner, or with one of another cluster, is an error when the result is read. Right keys are to be there once.
    """
    a = left.select(F.col(key).alias("_key"), F.struct(*left.columns).alias("_l"))
    b = right.select(F.col(key).alias("_key"), F.struct(*right.columns).alias("_r"))
    both = a.join(b, "_key", "left")
    of = lambda side: lambda c: F.col(side)[c]
    checked = failing(F.col("_r").isNull(), "a sample has no partner", failing(~F.col("_l")[cluster].eqNullSafe(F.col("_r")[cluster]), "clusters differ", value(of("_l"), of("_r")).cast("double")))
    return both.select(F.col("_l")[cluster].alias(cluster), checked.alias("_v")).where("_v is not null").groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))


def unused(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key another split doesn't use; a null key is used by nobody."""
    return rows.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_side_values(rows: DataFrame, side: DataFrame, key: str, columns: dict[str, object], valid: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Rows with columns of a side table, each at its default where the side has no row or a null; a value that its rule refuses is an error when read."""
    held = side.select(key, F.struct(*columns).alias("_side")).groupBy(key).agg(F.max("_side").alias("_side"))
    rules = valid or {}

    def column(name: str, default: object) -> Column:
        v = F.col(f"_side.{name}")
        if name in rules:
            v = F.when(v.isNotNull() & ~F.coalesce(rules[name](v), F.lit(False)), F.raise_error(F.lit(f"{name} is out of range")).cast("double")).otherwise(v)
        return F.coalesce(v, F.lit(default))

    return rows.join(held, key, "left").select(*[c for c in rows.columns if c not in columns], *[column(n, d).alias(n) for n, d in columns.items()])


def evidence_columns(kept: Column, tokens: Column, kept_places: Column, regions: Column) -> dict[str, Column]:
    return {
        "ecr": evidence_coverage(kept, regions), "evidence_center_recall": centre_recall(regions, kept), "evidence_patch_recall": patch_recall(tokens, regions, kept_places),
    }


def enriched(traces: DataFrame, probes: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Traces with evidence measures of their sample's regions where there are any, and the counts of what was matched.

    traces: key, ``tokens: array<box>``, ``kept: array<int>`` (places); probes: key, ``regions: array<box>``, one row a key. Traces without boxes or regions keep nulls and has_evidence false.
    """
    joined = traces.join(probes.select(key, "regions", F.lit(True).alias("_matched")), key, "left")
    some = F.coalesce((F.size("tokens") > 0) & (F.size("regions") > 0), F.lit(False))
    boxes = F.transform(F.filter("kept", lambda i: (i >= 0) & (i < F.size("tokens"))), lambda i: F.col("tokens")[i])
    joined = joined.withColumn("_boxes", boxes)
    values = evidence_columns(F.col("_boxes"), F.col("tokens"), F.col("kept"), F.col("regions"))
    out = joined.withColumns({n: F.when(some, c) for n, c in values.items()})
    out = out.withColumns({"ecr_half": (F.col("ecr") >= 0.5).cast("double"), "has_evidence": some, "evidence_region_count": F.when(some, F.size("regions"))})
    counts = out.agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.col("_matched").isNotNull()).alias("matched"), F.count_if("has_evidence").alias("with_evidence"))
    return out.drop("_boxes", "_matched"), counts


def model_rows(traces: DataFrame, probes: DataFrame, scores: DataFrame, full: DataFrame, key: str = "sample_id", tolerance: float = 2e-6) -> DataFrame:
    """Positive samples with what their mask keeps, how exact it is, and their margins with and without pruning.

    traces: key, tokens, kept, ecr; probes: key, polarity, regions; scores: key, margin, correct; full: key, margin. Every positive probe must be in all tables, and the stored ecr must be what the boxes say: else an error when the result is read.
    """
    wanted = probes.where(F.col("polarity") == "positive").select(key, "regions")
    side = lambda rows, n: rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias(n))
    all_four = wanted.join(side(traces, "_t"), key, "left").join(side(scores, "_s"), key, "left").join(side(full, "_f"), key, "left")
    tokens, kept = F.col("_t.tokens"), F.col("_t.kept")
    all_four = all_four.withColumn("_boxes", F.transform(F.filter(kept, lambda i: (i >= 0) & (i < F.size(tokens))), lambda i: F.get(tokens, i)))
    all_four = all_four.withColumns({"_ecr": evidence_coverage(F.col("_boxes"), F.col("regions")), "_area": union_area(F.col("regions")), "_lpp": local_precision(F.col("_boxes"), F.col("regions")), "_areas": F.array_sort(F.transform(tokens, area))})
    n = F.size("_areas")
    middle = (F.get("_areas", F.floor((n - 1) / 2).cast("int")) + F.get("_areas", F.floor(n / 2).cast("int"))) / 2
    all_four = all_four.withColumn("_cell", middle)
    missing = F.col("_t").isNull() | F.col("_s").isNull() | F.col("_f").isNull()
    ecr = failing(missing, "a positive sample is missing from a table", failing(F.abs(F.col("_ecr") - F.col("_t.ecr")) > tolerance, "the stored coverage is not that of the boxes", F.col("_ecr")))
    return all_four.select(
        key, F.size(tokens).alias("full_tokens"), F.size(kept).alias("kept_tokens"), F.col("_area").alias("evidence_area"), F.col("_cell").alias("median_cell_area"),
        F.when(F.col("_cell") > 0, F.col("_area") / F.col("_cell")).otherwise(F.lit(float("nan"))).alias("box_cell_ratio"), ecr.alias("ecr"), F.col("_lpp").alias("local_precision"), harmonic(F.col("_ecr"), F.col("_lpp")).alias("geo_f1"),
        F.col("_s.margin").alias("selected_margin"), F.col("_s.correct").cast("int").alias("selected_correct"), F.col("_f.margin").alias("full_margin"), F.abs(F.col("_f.margin")).alias("full_abs_margin"),
    )


def equivalence(full: DataFrame, low: DataFrame, key: str, risks: list[str], tolerance: float = 1e-8) -> DataFrame:
    """One row per risk: samples of either side, the mean and the largest difference over samples of both, and whether both are the same.

    A null risk counts as 0. Both sides are read once for all risks.
    """
    side = lambda rows, n: rows.select(key, F.lit(n).alias("_n"), F.array(*[F.coalesce(F.col(r).cast("double"), F.lit(0.0)) for r in risks]).alias("_v"))
    both = side(full, 0).unionByName(side(low, 1)).groupBy(key).agg(*[F.max(F.when(F.col("_n") == n, F.col("_v"))).alias(f"_{n}") for n in (0, 1)])
    long = both.select(F.posexplode(F.array(*map(F.lit, risks))).alias("_at", "risk"), "_0", "_1")
    d = F.abs(F.get("_0", F.col("_at")) - F.get("_1", F.col("_at")))
    sums = long.groupBy("risk").agg(F.count("_0").alias("full_samples"), F.count("_1").alias("low_samples"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_difference"), F.coalesce(F.max(d), F.lit(0.0)).alias("largest_difference"))
    return sums.withColumn("equivalent", (F.col("full_samples") == F.col("low_samples")) & (F.col("largest_difference") <= tolerance))


def seed_differences(target: DataFrame, controls: DataFrame, key: str, cluster: str, value: str, seed: str = "seed") -> DataFrame:
    """(seed, cluster, difference): means over a cluster of the target's value less that of each seed's run; (key, seed) is to be there once.

    Seeds that don't have every target sample are an error when the result is read, as their clusters could not be compared.
    """
    t = target.select(key, cluster, F.col(value).alias("_t"))
    runs = controls.groupBy(seed).agg(F.count(F.lit(1)).alias("_rows")).select(seed)
    wanted = t.groupBy(cluster).agg(F.count(F.lit(1)).alias("_wanted"))
    found = t.join(controls.select(key, seed, F.col(value).alias("_c")), key).groupBy(seed, cluster).agg(F.count(F.lit(1)).alias("_found"), F.avg(F.col("_t") - F.col("_c")).alias("_d"))
    # seeds are a handful of runs, clusters are many: the grid has a row per seed and cluster, as the result does
    grid = wanted.withColumn("_seeds", F.lit(0)).join(runs.agg(F.collect_set(seed).alias("_all")).withColumn("_seeds", F.lit(0)), "_seeds").select(cluster, "_wanted", F.explode("_all").alias(seed))
    out = grid.join(found, [seed, cluster], "left")
    return out.select(seed, cluster, failing(~F.col("_found").eqNullSafe(F.col("_wanted")), "a seed's run lacks samples of the target", F.col("_d")).alias("difference"))


def compare_arms(arms: DataFrame, left: str, right: str, key: str = "sample_id", arm: str = "arm", polarity: str = "target_answer", value: str = "support", n: int = DRAWS, seed: int = 0) -> DataFrame:
    """Left less right of two arms, over all samples and by polarity: n, mean, median, interval and two-sided p over resampled samples, the share above 0.

    Samples that lack either arm don't count; (key, arm) is to be there once.
    """
    at = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    pairs = arms.where(F.col(arm).isin(left, right)).groupBy(key).agg(F.max(polarity).alias("_pol"), at(left).alias("_l"), at(right).alias("_r")).where("_l is not null and _r is not null")
    scoped = pairs.select(key, (F.col("_l") - F.col("_r")).alias("value"), F.explode(F.array(F.lit("all"), F.col("_pol"))).alias("scope")).where("scope is not null")
    point = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg((F.col("value") > 0).cast("double")).alias("above"))
    draws = weighted(scoped, key, n, seed).groupBy("scope", "replicate").agg(weighted_mean()).where("mean is not null")
    share = lambda c: F.avg(c.cast("double"))
    ends = draws.groupBy("scope").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("mean") <= 0), share(F.col("mean") >= 0))).alias("p"))
    return point.join(ends, "scope", "left")


def lexical_strata(pairs: DataFrame, source: str, decoy: str, gap: str, seen: Column | None = None) -> DataFrame:
    """(stratum, bucket, n, mean, win): gaps of positive and decoy by the kind of edit, the source's shape and length and, if told, whether the decoy occurs elsewhere (null: not told)."""
    s, d = F.col(source), F.col(decoy)
    strata = {"edit_type": decoy_edit(s, d), "source_shape": shape_classes(s), "source_length": decoy_length(s)}
    if seen is not None:
        strata["decoy_seen_elsewhere"] = F.when(seen, "seen").when(~seen, "unseen")
    long = pairs.select(F.col(gap).alias("_gap"), F.explode(F.array(*[F.struct(F.lit(n).alias("stratum"), c.alias("bucket")) for n, c in strata.items()])).alias("s")).where("s.bucket is not null")
    return long.groupBy("s.stratum", "s.bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_gap").alias("mean"), F.avg((F.col("_gap") > 0).cast("double")).alias("win"))


def budget_summary(rows: DataFrame, kept: str, full: str, by: list[str]) -> DataFrame:
    """What budgets keep: means of counts, ratios (samples with tokens) and removed shares, and totals; zeros in one row for an empty table without keys."""
    k, n = F.col(kept), F.col(full)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), zero(F.avg(k)).alias("mean_kept"), zero(F.avg(F.when(n > 0, k / n))).alias("mean_ratio"), zero(F.avg(removal_fraction(n, k))).alias("mean_removed"), total(k).alias("total_kept"), total(n).alias("total_full")
    )


def probe_cost(probes: DataFrame, reusable: list[str], key: str = "sample_id", probe: str = "probe") -> DataFrame:
    """Mean probes and model calls (two a probe: yes and no) a sample, now and without the reusable ones, and the calls saved."""
    each = probes.select(key, probe).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_now"), F.count_if(~F.col(probe).isin(reusable)).alias("_less"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(F.count(F.lit(1)).alias("samples"), mean("_now").alias("probes"), mean(F.col("_now") * 2).alias("calls"), mean("_less").alias("reuse_probes"), mean(F.col("_less") * 2).alias("reuse_calls"), mean((F.col("_now") - F.col("_less")) * 2).alias("calls_saved"))


def decision(budget: Column, cost: Column, reason: str) -> Column:
    return F.struct(budget.cast("double").alias("budget"), cost.cast("double").alias("cost"), F.lit(reason).alias("reason"))


def pair_decision(a30: Column, a50: Column, accept: float, fallback: float) -> Column:
    """struct(budget, cost, reason): two small budgets that agree settle it; both are paid, and so is the fallback."""
    return F.when(answer_words(a30) == answer_words(a50), decision(F.lit(accept), F.lit(0.8), "answer30_eq_answer50")).otherwise(decision(F.lit(fallback), F.lit(0.8 + fallback), "answer30_ne_answer50"))


def staged_decision(a30: Column, a50: Column, a70: Column) -> Column:
    """The first two neighbouring budgets that agree, each paid on the way; the full budget where none do."""
    x, y, z = map(answer_words, (a30, a50, a70))
    return F.when(x == y, decision(F.lit(0.3), F.lit(0.8), "answer30_eq_answer50")).when(y == z, decision(F.lit(0.7), F.lit(1.5), "answer50_eq_answer70")).otherwise(decision(F.lit(1.0), F.lit(2.5), "unstable_30_50_70"))


def majority_decision(a30: Column, a50: Column, a70: Column) -> Column:
    """The smallest budget whose answer, unless empty, two of the three give; the full budget where none does."""
    x, y, z = map(answer_words, (a30, a50, a70))
    agree = lambda own, p, q: (own != "") & ((own == p) | (own == q))
    settled = F.when(agree(x, y, z), 0.3).when(agree(y, x, z), 0.5)
    return F.when(settled.isNotNull(), decision(settled, F.lit(1.5), "majority_answer")).otherwise(decision(F.lit(1.0), F.lit(2.5), "no_majority_answer"))


def length_sweep(rows: DataFrame, decode_ms: float, lengths: list[int]) -> DataFrame:
    """Rows once a detector mode and output length, with total latency if every token costs the same: full_ms, pruned_ms, speedup, reduction_pct.

    rows: full_ttft_ms, pruned_ttft_ms, detector_ms, detector_inclusive_ttft_ms; the online mode is there where a detector takes time.
    """
    modes = F.array_compact(F.array(F.struct(F.lit("no_detector").alias("detector_mode"), F.col("pruned_ttft_ms").alias("_base")), F.when(F.coalesce(F.col("detector_ms"), F.lit(0.0)) > 0, F.struct(F.lit("online_detector").alias("detector_mode"), F.col("detector_inclusive_ttft_ms").alias("_base")))))
    out = rows.select("*", F.inline(modes)).select("*", F.explode(F.array(*map(F.lit, lengths))).alias("generated_tokens"))
    out = out.withColumns({"full_ms": F.col("full_ttft_ms") + F.col("generated_tokens") * decode_ms, "pruned_ms": F.col("_base") + F.col("generated_tokens") * decode_ms})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"speedup": ratio("full_ms", "pruned_ms"), "reduction_pct": F.when(F.col("full_ms") > 0, 100 * (1 - F.col("pruned_ms") / F.col("full_ms"))).otherwise(0.0)}).drop("_base")


def trace_pairs(traces: DataFrame, fields: list[str], key: str = "sample_id", answer: str = "answer") -> DataFrame:
    """One row per sample with the yes trace's, the no trace's and the mean value of each field; a missing value is 0."""
    at = lambda c, a: F.coalesce(F.max(F.when(F.col(answer) == a, F.col(c))), F.lit(0.0))
    wide = traces.groupBy(key).agg(*[at(c, a).alias(f"{a}_{c}") for c in fields for a in ("yes", "no")])
    return wide.withColumns({f"mean_{c}": (F.col(f"yes_{c}") + F.col(f"no_{c}")) / 2 for c in fields})


def masked_views(rows: DataFrame, evidence: str, random_region: str) -> DataFrame:
    """Each row as original, with its evidence masked and with a region of the same size masked: probe, view, occlusion, mask_regions (null for the original) and random_regions."""
    region = F.array(F.col(random_region))
    none = F.lit(None).cast(rows.schema[evidence].dataType)
    view = lambda probe, kind, occlusion, mask, drawn: F.struct(F.lit(probe).alias("probe"), F.lit(kind).alias("view"), F.lit(occlusion).alias("occlusion"), mask.alias("mask_regions"), drawn.alias("random_regions"))
    has = F.when(F.size(evidence) > 0, F.col(evidence))
    views = F.array(view("orig", "original", "original", none, none), view("evidence_masked", "evidence_masked", "evidence", has, none), view("random_masked", "mask_regions", "random_same_size", region, region))
    return rows.select("*", F.inline(views), F.lit(3).alias("probe_count"))


def controlled(rows: DataFrame, mapping: DataFrame, paths: DataFrame, control: str, seed: int | None, image: str = "image_id") -> DataFrame:
    """Rows with the image of their control: original_image, control_type, control_seed, control_image_id (null for blank) and the path of their own id as image.

    mapping: image, mapped; paths: image, path. Groups that aren't pairs, and images without a mapping or path, are errors when the result is read.
    """
    sizes = rows.groupBy(image).agg(F.count(F.lit(1)).alias("_size"))
    joined = rows.join(sizes, image).join(mapping.select(image, "mapped"), image, "left").join(paths.select(image, "path"), image, "left")
    bad = (F.col("_size") != 2) | F.col("mapped").isNull() | F.col("path").isNull()
    path = F.when(bad, F.raise_error(F.lit("an image's rows are not a pair with a control"))).otherwise(F.col("path"))
    kept = [c for c in rows.columns if c != "image"]
    control_id = F.col("mapped") if control != "blank" else F.lit(None).cast(mapping.schema["mapped"].dataType)
    return joined.select(*kept, F.col("image").alias("original_image"), F.lit(control).alias("control_type"), F.lit(seed).cast("int").alias("control_seed"), control_id.alias("control_image_id"), path.alias("image"))


def salvaged(samples: DataFrame, rows: DataFrame, traces: DataFrame, order: str = "ord", key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Rows and traces of a stopped run that both exist, in the samples' order: what was written by halves at the end goes.

    An error: empty or repeated ids, ids of no sample, finished samples that aren't the first ones, and half-written ones that don't follow right after them.
    One aggregate over the three tables decides; only its four numbers reach the driver.
    """
    side = lambda df, n: df.select(key, F.lit(n).alias("_n"), (F.col(order) if n == 0 else F.lit(None)).cast("long").alias("_ord"))
    count = lambda n: F.count_if(F.col("_n") == n).alias(f"_{n}")
    seen = side(samples, 0).unionByName(side(rows, 1)).unionByName(side(traces, 2)).groupBy(key).agg(count(0), count(1), count(2), F.max("_ord").alias("_ord"))
    refuse(seen.where(f"_1 > 1 or _2 > 1 or ((_1 + _2) > 0 and coalesce(cast(`{key}` as string), '') = '')"), "the checkpoint has empty or repeated ids")
    refuse(seen.where("_0 = 0"), "the checkpoint has ids of no sample")
    whole, half = (F.col("_1") == 1) & (F.col("_2") == 1), (F.col("_1") + F.col("_2")) == 1
    place = lambda c, f: f(F.when(c, F.col("_ord")))
    ends = seen.agg(place(whole, F.max).alias("last"), place(half, F.min).alias("half"), place(half, F.max).alias("last_half"), place((F.col("_1") + F.col("_2")) == 0, F.min).alias("open")).first()
    open_at = ends["open"] if ends["open"] is not None else float("inf")
    if ends["last"] is not None and ends["last"] > min(open_at, ends["half"] if ends["half"] is not None else float("inf")):
        raise ValueError("what is finished is not the beginning of the samples")
    if ends["half"] is not None and ends["last_half"] > open_at:
        raise ValueError("what is written by halves does not follow what is finished")
    done = seen.where(whole).select(key, F.col("_ord").alias(f"_{order}"))
    keep = lambda df: df.join(done, key).orderBy(f"_{order}").drop(f"_{order}")
    return keep(rows), keep(traces)


def decoys(rows: DataFrame, key: str, answer: str, kind: str, seed: int = 0) -> DataFrame:
    """(key, decoy): for each row another answer of its kind, else of any kind; null where every answer is the same.

    Distinct answers (case ignored) stand in hash order inside buckets of their kind, and each row takes the one after its own, the first after the last: no row meets a whole pool, and no task orders one.
    An answer alone in its bucket takes its kind's first or last answer, one alone in its kind that of all.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_low")))
    pool = rows.where(F.coalesce(F.col(answer), F.lit("")) != "").groupBy(F.col(kind).alias("_kind"), F.lower(F.col(answer)).alias("_low")).agg(F.min(answer).alias("_text"))
    w = Window.partitionBy("_kind", F.substring("_h", 1, 2)).orderBy("_h", "_low")
    turn = F.coalesce(F.lead("_text").over(w), F.first("_text").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = pool.withColumn("_h", digest).select("_kind", "_low", turn.alias("_next"))
    ends = lambda name: [F.min_by("_text", "_low").alias(f"{name}_first"), F.max_by("_text", "_low").alias(f"{name}_last")]
    out = rows.select(key, F.col(kind).alias("_kind"), F.lower(F.col(answer)).alias("_low")).join(after, ["_kind", "_low"], "left").join(pool.groupBy("_kind").agg(*ends("_k")), "_kind", "left")
    out = out.crossJoin(F.broadcast(pool.agg(*ends("_a"))))  # one row
    other = lambda c: F.when(~F.lower(c).eqNullSafe(F.col("_low")), F.col(c))
    return out.select(key, F.coalesce(*[other(c) for c in ("_next", "_k_first", "_k_last", "_a_first", "_a_last")]).alias("decoy"))


#: Means of a trace summary: the fields that may hold a value, the first there is; whether only traces with evidence count.
TRACE_MEANS = {
    "full_sequence_tokens": (["full_sequence_tokens"], False), "pruned_sequence_tokens": (["pruned_sequence_tokens"], False), "full_visual_tokens": (["full_visual_tokens"], False), "kept_visual_tokens": (["kept_visual_tokens"], False),
    "removal_fraction": (["removal_fraction"], False), "ecr": (["ecr"], True), "anchor_ecr": (["anchor_ecr", "ecr"], True), "evidence_center_recall": (["evidence_center_recall"], True), "evidence_patch_recall": (["evidence_patch_recall"], True),
    **{f"{c}_ms": ([f"mean_{c}_ms", f"{c}_ms"], False) for c in ("vision", "target_text", "score_compute", "selector", "prune_materialize", "prune_overhead", "language")}, "forward_ms": (["mean_forward_ms"], False),
}


def trace_summary(traces: DataFrame, by: list[str], evidence: str = "has_evidence") -> DataFrame:
    """(by, traces, mean_keep_ratio, then a mean for each of :data:`TRACE_MEANS`): a missing field or value counts as 0, the keep ratio only where there are tokens, coverage and recalls only where there is evidence; a mean over nothing is 0. Without keys, no traces give one row of zeros."""
    have = set(traces.columns)
    value = lambda names: F.coalesce(*[F.col(n).cast("double") for n in names if n in have], F.lit(0.0))
    some = F.coalesce(F.col(evidence).cast("boolean"), F.lit(False)) if evidence in have else F.lit(False)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    full, kept = value(["full_visual_tokens"]), value(["kept_visual_tokens"])
    means = [mean(F.when(some, value(names)) if only else value(names)).alias(f"mean_{n}") for n, (names, only) in TRACE_MEANS.items()]
    return traces.groupBy(*by).agg(F.count(F.lit(1)).alias("traces"), mean(F.when(full > 0, kept / full)).alias("mean_keep_ratio"), *means)
