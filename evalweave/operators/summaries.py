"""Audits of samples and probes, metric maps cut to what a report shows, and run differences by cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.joins import refuse
from evalweave.operators.resampling import DRAWS, cluster_means, weighted, weighted_mean

EMPTY = "<empty>"


def sample_audit(samples: DataFrame, kinds: dict[str, Column], tags: Column | None = None) -> DataFrame:
    """(kind, value, samples): how many samples have each value of each kind, and each of their ``tags`` (an array, each tag once a sample) under the kind "tag"; a null or empty value is :data:`EMPTY`. One partial count of all kinds."""
    own = lambda c: F.when(F.coalesce(c.cast("string"), F.lit("")) == "", EMPTY).otherwise(c.cast("string"))
    counted = F.array(*[F.struct(F.lit(k).alias("kind"), own(c).alias("value")) for k, c in kinds.items()])
    if tags is not None:
        counted = F.concat(counted, F.transform(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))), lambda t: F.struct(F.lit("tag").alias("kind"), own(t).alias("value"))))
    return samples.select(F.inline(counted)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("samples"))


def visual_audit(probes: DataFrame, view: str, found: Column) -> DataFrame:
    """One row: probes, text_only, visual, missing, missing_rate; probes of the view "text_only" need no image, the others miss one where ``found`` isn't true."""
    visual = ~F.col(view).eqNullSafe("text_only")
    missing = visual & ~F.coalesce(found, F.lit(False))
    out = probes.agg(F.count(F.lit(1)).alias("probes"), F.count_if(~visual).alias("text_only"), F.count_if(visual).alias("visual"), F.count_if(missing).alias("missing"))
    return out.withColumn("missing_rate", F.when(F.col("visual") > 0, F.col("missing") / F.col("visual")).otherwise(0.0))


def missing_images(probes: DataFrame, view: str, found: Column, order: list[str], most: int = 10) -> DataFrame:
    """The first probes that need an image and miss it."""
    return probes.where(~F.col(view).eqNullSafe("text_only") & ~F.coalesce(found, F.lit(False))).orderBy(*order).limit(most)


#: Sets of risks that a report shows: the prefixes of metric names that call for a set, those that rule it out, and its risks; the first that applies counts, the last always does.
MAIN_RISKS = [
    (["prompt_sc_"], ["evidence_"], ["confidence", "prompt_sc"]),
    (["choice_"], [], ["confidence", "e_spec", "choice_top2", "choice_wo_prior"]),
    (["evidence_", "selector_"], [], ["confidence", "evidence", "selector", "selector_wo_conf"]),
    (["relation_"], [], ["confidence", "relation", "relation_wo_prior"]),
    ([], [], ["confidence", "visual_lift", "lift", "profile_wo_prior"]),
]
#: Metrics that a report shows of each risk; the first two at a coverage.
SHOWN = ["selective_accuracy", "hallucination_fpr", "error_auroc", "hallucination_auroc"]


def main_risks(metrics: Column, sets: list[tuple[list[str], list[str], list[str]]] = MAIN_RISKS) -> Column:
    """The risks of the first set that a map of metrics calls for, of those that it has metrics of."""
    keys = F.map_keys(metrics)
    some = lambda prefixes: F.exists(keys, lambda k: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(k, p))) if prefixes else F.lit(False)
    present = lambda risks: F.filter(F.array(*map(F.lit, risks)), lambda r: F.exists(keys, lambda k: F.startswith(k, F.concat(r, F.lit("_")))))
    out = None
    for wanted, without, risks in sets[:-1]:
        applies = some(wanted) & ~some(without)
        out = F.when(applies, present(risks)) if out is None else out.when(applies, present(risks))
    return present(sets[-1][2]) if out is None else out.otherwise(present(sets[-1][2]))


def compact_metrics(rows: DataFrame, keys: list[str], metrics: str = "metrics", risks: list[str] | None = None, coverage: int = 80) -> DataFrame:
    """(keys, risk, metric, value): what a report shows of a map of metrics named <risk>_<metric>, for the given risks or those of :func:`main_risks`, in their order (place)."""
    chosen = F.array(*map(F.lit, risks)) if risks is not None else main_risks(F.col(metrics))
    shown = F.array(*[F.lit(f"{m}_{coverage}cov" if i < 2 else m) for i, m in enumerate(SHOWN)])
    found = rows.select(*keys, F.col(metrics).alias("_m"), F.posexplode(chosen).alias("place", "risk")).select(*keys, "_m", "place", "risk", F.explode(shown).alias("metric"))
    name = F.concat("risk", F.lit("_"), "metric")
    return found.where(F.map_contains_key("_m", name)).select(*keys, (F.col("place") + 1).alias("place"), "risk", "metric", F.element_at("_m", name).alias("value"))


def reused_rows(requested: DataFrame, rows: DataFrame, key: str, answer: str, protocol: dict[str, object] | None = None, given: dict[str, object] | None = None) -> DataFrame:
    """The reused rows of the requested keys. An error if a row has no key or answer, a key repeats, a requested key is missing, or the rows' ``given`` protocol differs from the wanted one."""
    for name, want in (protocol or {}).items():
        if (given or {}).get(name) != want:
            raise ValueError(f"reused rows have {name} {(given or {}).get(name)!r}, not {want!r}")
    refuse(rows.where((F.coalesce(F.col(key).cast("string"), F.lit("")) == "") | F.col(answer).isNull()), "reused rows without a key or an answer")
    refuse(rows.groupBy(key).count().where("count > 1"), "reused rows repeat a key")
    asked = requested.select(key).distinct()
    refuse(asked.join(rows.select(key), key, "left_anti"), "requested keys are missing among the reused rows")
    return rows.join(asked, key, "left_semi")


def run_difference(left: DataFrame, right: DataFrame, key: str, value: str, cluster: str | None = None, polarity: tuple[str, str] | None = None, n: int = DRAWS, seed: int = 0) -> DataFrame:
    """One row: common (keys of both runs), clusters, difference (left - right, the mean over clusters of their means) and an interval over resampled clusters: low and high are the sorted draws at places int(0.025 n) and int(0.975 n), as there are n.

    A row's cluster is the left run's, or the part of its key before a colon where that is empty. ``polarity`` is a column of the left run and the value that counts. Draws without a cluster don't count.
    """
    own = F.split_part(F.col(key).cast("string"), F.lit(":"), F.lit(1))
    given = F.coalesce(F.nullif(F.col(cluster).cast("string"), F.lit("")), own) if cluster else own
    a = left.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_a"), given.alias("_cluster"), (F.col(polarity[0]) == polarity[1] if polarity else F.lit(True)).alias("_counts"))
    both = a.join(right.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_b")), "_key")
    rows = both.where("_counts").select("_cluster", (F.col("_a") - F.col("_b")).alias("_d"))
    means = cluster_means(rows, "_cluster", "_d", [])
    drawn = weighted(means, "_cluster", n, seed).groupBy("replicate").agg(weighted_mean()).where("mean is not null")
    sorted_ = drawn.agg(F.sort_array(F.collect_list("mean")).alias("_m"))  # n numbers at most
    at = lambda q: F.get("_m", F.floor(F.size("_m") * q).cast("int"))
    ends = sorted_.select(at(0.025).alias("low"), at(0.975).alias("high"))
    point = means.agg(F.count(F.lit(1)).alias("clusters"), F.avg("value").alias("difference")).crossJoin(F.broadcast(both.agg(F.count(F.lit(1)).alias("common"))))  # one row each
    return point.crossJoin(F.broadcast(ends)).select("common", "clusters", "difference", "low", "high")
