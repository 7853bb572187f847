"""Claim, anti and support evidence of a relation; candidate expansion; role swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.maths import signed_support


def relation_candidates(samples: DataFrame, relations: DataFrame) -> DataFrame:
    """Each sample with every candidate of its relation, seen with and without the image."""
    s = samples.join(relations.select("relation", "candidates"), "relation", "left")
    s = s.withColumn("candidate", F.explode(F.coalesce("candidates", F.array("relation")))).drop("candidates")
    return s.withColumn("view", F.explode(F.array(F.lit("img"), F.lit("text"))))


def graph_candidates(samples: DataFrame, relations: DataFrame) -> DataFrame:
    """(role, candidate, weight): the canonical claim, its anti and support relations, once each; ``swapped`` tells that subject and object change places."""
    canonical = relations.select(F.col("relation"), "canonical", "swaps")
    graph = relations.select(F.col("relation").alias("canonical"), "anti", "support", "support_weight")
    dims = canonical.join(graph, "canonical")
    roles = F.array(
        F.struct(F.lit("claim").alias("role"), F.col("canonical").alias("candidate"), F.lit(0.0).alias("weight")),
        F.struct(F.lit("anti").alias("role"), F.col("anti").alias("candidate"), F.lit(0.0).alias("weight")),
        F.struct(F.lit("support").alias("role"), F.col("support").alias("candidate"), F.col("support_weight").alias("weight")),
    )
    out = samples.join(dims, "relation").select("*", F.explode(F.filter(roles, lambda r: r["candidate"] != "")).alias("c"))
    return out.select(*samples.columns, F.col("swaps").alias("swapped"), "c.*")


def claim_evidence(records: DataFrame, sample: str = "sample_id", predicted: str = "predicted") -> DataFrame:
    """claim - best anti - weighted support penalty for each sample; records: sample, role, img, text, weight, predicted.

    Records without an image margin don't count; a missing text margin is 0; without anti and support records the evidence is 0.
    """
    rows = records.where(F.col("img").isNotNull()).withColumn("delta", F.col("img") - F.coalesce("text", F.lit(0.0)))
    role = lambda r: F.col("role") == r
    out = rows.groupBy(sample).agg(
        F.count(F.lit(1)).alias("candidates"), F.coalesce(F.max(F.when(role("claim"), F.col("delta"))), F.lit(0.0)).alias("claim_delta"), F.max(F.when(role("anti"), F.col("delta"))).alias("best_anti_delta"),
        F.coalesce(F.sum(F.when(role("support"), F.col("weight") * F.greatest(F.lit(0.0), -F.col("delta")))), F.lit(0.0)).alias("support_penalty"),
        F.count_if(role("anti") | role("support")).alias("_contrast"), F.max(predicted).alias(predicted),
    )
    pair = F.col("claim_delta") - F.coalesce("best_anti_delta", F.lit(0.0))
    margin = F.when(F.col("_contrast") > 0, pair - F.col("support_penalty")).otherwise(0.0)
    out = out.withColumn("pair_margin", pair).withColumn("evidence_margin", margin).withColumn("has_contrast", F.col("_contrast") > 0)
    return out.withColumn("evidence_risk", F.when(F.col("has_contrast"), -signed_support(F.col("evidence_margin"), F.col(predicted) == "yes")).otherwise(0.0)).drop("_contrast")


def swap_roles(samples: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paired columns under each other's names."""
    other = dict(pairs) | {b: a for a, b in pairs}
    return samples.select(*[F.col(other.get(c, c)).alias(c) for c in samples.columns])


def require_probes(probes: DataFrame, names: list[str], sample: str = "sample_id") -> DataFrame:
    """Probes of the named kinds, of samples that have all of them; probe_count counts what is kept."""
    kept = probes.where(F.col("probe").isin(names))
    whole = kept.groupBy(sample).agg(F.count_distinct("probe").alias("_kinds"), F.count(F.lit(1)).alias("probe_count")).where(F.col("_kinds") == len(set(names))).drop("_kinds")
    return kept.drop("probe_count").join(whole, sample)


def fill_missing_role(records: DataFrame, role: str, source: str, sample: str = "sample_id") -> DataFrame:
    """Samples without a record of ``role`` get a copy of their ``source`` record under that role."""
    have = records.where(F.col("role") == role).select(sample).distinct()
    made = records.where(F.col("role") == source).join(have, sample, "left_anti").withColumn("role", F.lit(role))
    return records.unionByName(made)


def reuse_is_valid(records: DataFrame, original: str, reused: str, by: list[str], tolerance: float = 1e-8) -> DataFrame:
    return records.groupBy(*by).agg(F.coalesce(F.every(F.abs(F.col(original) - F.col(reused)) <= tolerance), F.lit(True)).alias("valid"))


def ablation_risks(candidates: DataFrame, sample: str = "sample_id", predicted: str = "predicted") -> DataFrame:
    """A row per sample: what its evidence risk would be with parts left out, from candidates (role, img, text, weight): claim, anti, pair, image pair, text pair, claim image, claim text; and the pair's and the evidence margin and the number of support candidates.

    Candidates without an image margin don't count; a missing text margin is 0; anti values are the largest, 0 without any. Without an anti or support candidate all risks and the evidence margin are 0. Risks support the predicted answer.
    """
    rows = candidates.where("img is not null").withColumn("text", F.coalesce("text", F.lit(0.0))).withColumn("delta", F.col("img") - F.col("text"))
    of = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0.0))
    parts = [of(role, c).alias(f"{role}_{c}") for role in ("claim", "anti") for c in ("img", "text", "delta")]
    penalty = F.coalesce(F.sum(F.when(F.col("role") == "support", F.coalesce("weight", F.lit(0.0)) * F.greatest(F.lit(0.0), -F.col("delta")))), F.lit(0.0))
    found = rows.groupBy(sample).agg(*parts, penalty.alias("_penalty"), F.count_if(F.col("role") == "support").alias("supports"), F.count_if(F.col("role").isin("anti", "support")).alias("_contrast"))
    out = candidates.groupBy(sample).agg(F.max(predicted).alias(predicted)).join(found, sample, "left").na.fill(0).withColumns({f"{c}_pair": F.col(f"claim_{c}") - F.col(f"anti_{c}") for c in ("img", "text", "delta")})
    yes, some = F.lower(predicted) == "yes", F.col("_contrast") > 0
    for_it = lambda c: F.when(some, signed_support(F.col(c), yes)).otherwise(0.0)
    risks = {"claim_delta": -for_it("claim_delta"), "anti_delta": for_it("anti_delta"), "pair_delta": -for_it("delta_pair"), "img_pair": -for_it("img_pair"), "text_pair": -for_it("text_pair"), "claim_img": -for_it("claim_img"), "claim_text_prior": for_it("claim_text")}
    margin = F.when(some, F.col("delta_pair") - F.col("_penalty")).otherwise(0.0)
    return out.select(sample, *[(c + 0.0).alias(f"{k}_risk") for k, c in risks.items()], F.col("delta_pair").alias("pair_margin"), margin.alias("evidence_margin"), "supports")
