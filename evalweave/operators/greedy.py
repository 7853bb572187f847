"""Sequential selection inside one sample's tokens: each pick depends on those before, so a sample is an Arrow batch of its own.

A sample has as many rows as its image has tokens (some thousands); samples are dealt by key, so that the number of tasks grows with the samples.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.boxes import centre_recall, evidence_coverage, patch_recall
from evalweave.functions.maths import keep_count
from evalweave.operators import staged


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def minmax(x: np.ndarray) -> np.ndarray:
    span = float(x.max() - x.min()) if len(x) else 0.0
    return (x - x.min()) / span if span > 1e-12 else np.zeros_like(x, dtype=float)


def _argmax(gain: np.ndarray, free: np.ndarray) -> int:
    """The first free place of the largest gain."""
    return int(np.argmax(np.where(free, gain, -np.inf)))


def facility_location(v: np.ndarray, saliency: np.ndarray, k: int, alpha: float = 1.0) -> list[int]:
    """Picks that add most to the similarity with which all tokens are covered, weighted by saliency."""
    u = unit(v)
    sim, cover, free, out = u @ u.T, np.zeros(len(v)), np.ones(len(v), dtype=bool), []
    for _ in range(min(k, len(v))):
        gain = np.maximum(0, sim - cover[:, None]).sum(axis=0) * saliency**alpha
        j = _argmax(gain, free)
        free[j] = False
        cover = np.maximum(cover, sim[:, j])
        out.append(j)
    return out


def orthogonal(v: np.ndarray, text: np.ndarray, k: int, alpha: float = 0.5, beta: float = 0.5) -> list[int]:
    """Directions that earlier picks do not span, mixed with length and agreement with the text's mean (Gram-Schmidt)."""
    u = unit(v)
    mean = text.mean(axis=0, keepdims=True) if len(text) else np.zeros((1, v.shape[1]))
    worth = beta * minmax(np.linalg.norm(v, axis=1)) + (1 - beta) * minmax((u @ unit(mean).T)[:, 0])
    spanned, basis, free, out = np.zeros(len(v)), [], np.ones(len(v), dtype=bool), []
    for _ in range(min(k, len(v))):
        j = _argmax(alpha * np.sqrt(np.maximum(0, 1 - spanned)) + (1 - alpha) * worth, free)
        free[j] = False
        out.append(j)
        r = u[j] - sum((b @ u[j]) * b for b in basis) if basis else u[j]
        if (n := np.linalg.norm(r)) > 1e-9:
            basis.append(r / n)
            spanned = np.minimum(1, spanned + (u @ basis[-1]) ** 2)
    return out


def anchors_then_novelty(v: np.ndarray, relevance: np.ndarray, k: int, share: float = 0.5) -> list[int]:
    """A share of anchors by relevance, then the tokens least similar to anything picked, ties by relevance."""
    u, k = unit(v), min(k, len(v))
    order = np.lexsort((np.arange(len(v)), -relevance))
    picked = order[: max(1, round(share * k))].tolist()
    free = np.ones(len(v), dtype=bool)
    free[picked] = False
    while len(picked) < k:
        j = _argmax(1 - (u @ u[picked].T).max(axis=1), free)
        free[j] = False
        picked.append(j)
    return picked


def dominant_and_contextual(v: np.ndarray, attention: np.ndarray, k: int) -> tuple[list[int], list[int], np.ndarray]:
    """Dominant picks by attention, evenly spaced contextual ones among the rest, and for each left-over token the contextual one it merges into."""
    k = min(k, len(v))
    contextual = max(1, round(10 * k / 64)) if k > 1 else 0
    dominant = np.lexsort((np.arange(len(v)), -attention))[: k - contextual]
    rest = np.setdiff1d(np.arange(len(v)), dominant)
    step = max(1, len(rest) // max(1, contextual))
    centres = rest[::step][:contextual]
    left = np.setdiff1d(rest, centres)
    u = unit(v)
    owner = centres[(u[left] @ u[centres].T).argmax(axis=1)] if len(left) and len(centres) else np.zeros(0, int)
    return dominant.tolist(), centres.tolist(), np.stack([left, owner], axis=1) if len(left) and len(centres) else np.zeros((0, 2), int)


def greedy_box_match(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float]]:
    """One-to-one pairs of boxes by falling IoU (ties: first pair)."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.maximum(0, w) * np.maximum(0, h)
    size = lambda x: np.maximum(0, x[:, 2] - x[:, 0]) * np.maximum(0, x[:, 3] - x[:, 1])
    iou = inter / np.maximum(size(a)[:, None] + size(b)[None, :] - inter, 1e-300)
    out, used_a, used_b = [], set(), set()
    for at in np.argsort(-iou, axis=None, kind="stable").tolist():
        i, j = divmod(at, len(b))
        if iou[i, j] <= least:
            break
        if i not in used_a and j not in used_b:
            out.append((i, j, float(iou[i, j])))
            used_a.add(i)
            used_b.add(j)
    return out


def select_per_sample(tokens: DataFrame, sample: str, index: str, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """(sample, index, step): ``choose`` gets one sample's tokens by index and gives row places in the order of the picks."""
    fields = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(index).reset_index(drop=True)
        picks = choose(rows)
        return pd.DataFrame({sample: rows[sample].iloc[:1].repeat(len(picks)).to_numpy(), index: rows[index].to_numpy()[picks], "step": np.arange(1, len(picks) + 1)})

    return tokens.groupBy(sample).applyInPandas(one, f"`{sample}` {fields[sample]}, `{index}` {fields[index]}, step int")


def vectors_of(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in rows[column]])


#: Selectors that look at vectors; those of :mod:`evalweave.operators.staged` look at boxes and scores.
VECTOR_SELECTORS: dict[str, Callable[[pd.DataFrame, int], list[int]]] = {
    "facility_location": lambda r, k: facility_location(vectors_of(r, "vec"), r["saliency"].to_numpy(float), k),
    "orthogonal": lambda r, k: orthogonal(vectors_of(r, "vec"), np.zeros((0, len(r["vec"].iloc[0]))), k),
    "anchor_novelty": lambda r, k: anchors_then_novelty(vectors_of(r, "vec"), r["relevance"].to_numpy(float), k),
    "dominant_contextual": lambda r, k: [i for part in dominant_and_contextual(vectors_of(r, "vec"), r["saliency"].to_numpy(float), k)[:2] for i in part],
}


def run_selector(tokens: DataFrame, name: str, k: int, sample: str = "sample_id", index: str = "idx") -> DataFrame:
    """(sample, index, step) of the tokens that a named selector keeps; those that look at boxes and scores are plans (:mod:`evalweave.operators.staged`)."""
    if name in VECTOR_SELECTORS:
        return select_per_sample(tokens, sample, index, lambda rows: VECTOR_SELECTORS[name](rows, k))
    if name not in staged.NAMES:
        raise ValueError(f"no selector {name}; there are {sorted([*staged.NAMES, *VECTOR_SELECTORS])}")
    return staged.select(tokens, name, sample, index, F.lit(k))


def sweep(tokens: DataFrame, names: list[str], ratios: list[float], sample: str = "sample_id", index: str = "idx") -> DataFrame:
    """(sample, selector, keep_ratio, n, kept): every selector at every budget on a sample's tokens; kept holds indices in order. A selector is one plan over all budgets."""
    tried = tokens.select("*", F.explode(F.array(*map(F.lit, ratios))).alias("keep_ratio"))
    sizes = tokens.groupBy(sample).agg(F.count(F.lit(1)).cast("int").alias("n"))
    kept = [staged.select(tried, name, sample, index, keep_count(F.col("_n"), F.col("keep_ratio")), by=[sample, "keep_ratio"]).groupBy(sample, "keep_ratio").agg(F.sort_array(F.collect_list(index)).alias("kept")).withColumn("selector", F.lit(name)) for name in names]
    return reduce(DataFrame.unionByName, kept).join(sizes, sample).select(sample, "selector", "keep_ratio", "n", "kept")


def sweep_coverage(swept: DataFrame, tokens: DataFrame, regions: DataFrame, sample: str = "sample_id", index: str = "idx") -> DataFrame:
    """Each mask of :func:`sweep` with the evidence it keeps: ecr, whether it is one half at least, centre and patch recall, removed share."""
    boxes = tokens.select(sample, index, F.struct("x1", "y1", "x2", "y2").alias("box")).groupBy(sample).agg(F.sort_array(F.collect_list(F.struct(index, "box"))).alias("b"))
    boxes = boxes.select(sample, F.transform("b", lambda s: s["box"]).alias("boxes"), F.transform("b", lambda s: s[index]).alias("ids"))
    rows = swept.join(boxes, sample).join(regions, sample, "left")
    places = F.transform("kept", lambda i: (F.array_position("ids", i) - 1).cast("int"))
    kept = F.transform(F.col("places"), lambda i: F.col("boxes")[i])
    rows = rows.withColumn("places", places).withColumn("kept_boxes", kept).withColumn("evidence", F.coalesce("regions", F.slice("boxes", 1, 0)))
    rows = rows.withColumn("ecr", evidence_coverage(F.col("kept_boxes"), F.col("evidence")))
    return rows.select(
        sample, "selector", "keep_ratio", "n", "kept", F.size("kept").alias("kept_count"), (1 - F.size("kept") / F.col("n")).alias("removed"), (F.size("evidence") > 0).alias("has_evidence"), "ecr",
        (F.col("ecr") >= 0.5).cast("double").alias("ecr_half"), centre_recall(F.col("kept_boxes"), F.col("evidence")).alias("centre_recall"), patch_recall(F.col("boxes"), F.col("evidence"), F.col("places")).alias("patch_recall"),
    )


def sweep_summary(covered: DataFrame) -> DataFrame:
    """Means by selector and budget; those of evidence over samples that have some, 0 without any."""
    some = lambda c: F.coalesce(F.avg(F.when(F.col("has_evidence"), F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    return covered.groupBy("selector", "keep_ratio").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("has_evidence").alias("with_evidence"), F.avg("kept_count").alias("mean_kept"), F.avg("removed").alias("mean_removed"), *map(some, ("ecr", "ecr_half", "centre_recall", "patch_recall"))
    )
