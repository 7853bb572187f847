"""Selection that reads vectors, against loops over one sample's tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions.maths import keep_count
from evalweave.operators import greedy, merging
from evalweave.plans import inputs


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def anchors_by_loop(relevance, vectors, k, k_min, tau, patience, most):
    k = min(k, len(relevance))
    low = min(max(1, k_min), k)
    high = min(max(low, int(most * k)), k)
    ranked = np.lexsort((np.arange(len(relevance)), -relevance))
    u, chosen, new = unit(vectors), high, 0
    for place in range(low + 1, high + 1):
        new += (1 - u[ranked[:low]] @ u[ranked[place - 1]]).min() > tau
        if new >= patience:
            chosen = place
            break
    return ranked[:chosen].tolist()


def expansion_by_loop(vectors, importance, k, anchors):
    u, w = unit(vectors), np.maximum(0, importance)
    picked = list(anchors[:k]) or [int(np.argmax(w))]
    while len(picked) < min(k, len(u)):
        near = np.minimum(1, (1 - u @ u[picked].T).min(axis=1)) * w
        near[picked] = -1e9
        picked.append(int(np.argmax(near)))
    return sorted(picked)


def samples(spark, seed=0, dims=6):
    rng, rows = np.random.default_rng(seed), []
    for s, n in enumerate([1, 2, 3, 9, 30, 30]):
        v = rng.normal(size=(n, dims)).round(3)
        if s == 5:
            v[::2] = v[0]  # repeated vectors
        for i in range(n):
            rows.append((s, i, float(rng.integers(0, 6)), round(float(rng.normal()), 3), v[i].tolist()))
    return spark.createDataFrame(rows, "sample_id int, idx int, relevance double, saliency double, vec array<double>"), rows


@pytest.mark.parametrize(("ratio", "k_min", "tau", "patience"), [(0.5, 2, 0.2, 3), (1.0, 1, 0.9, 1), (0.3, 50, 0.5, 2)])
def test_anchors_and_expansion_against_loops(spark, ratio, k_min, tau, patience):
    df, rows = samples(spark)
    keep = keep_count(F.col("n"), ratio)
    anchors = merging.adaptive_anchors(df, "sample_id", "idx", "relevance", "vec", keep, k_min, tau, patience)
    got = {}
    for r in sorted(anchors.collect(), key=lambda r: r.place):
        got.setdefault(r.sample_id, []).append(r.idx)
    picked = {}
    for r in merging.expand_by_importance(df, anchors, "sample_id", "idx", "vec", "saliency", keep).collect():
        picked.setdefault(r.sample_id, []).append((r.idx, r.is_anchor))
    for s in range(6):
        own = [r for r in rows if r[0] == s]
        k = max(1, min(len(own), int(np.ceil(len(own) * ratio))))
        v = np.array([r[4] for r in own])
        want = anchors_by_loop(np.array([r[2] for r in own]), v, k, k_min, tau, patience, 0.5)
        assert got[s] == want
        assert sorted(picked[s]) == [(i, i in want) for i in expansion_by_loop(v, np.array([r[3] for r in own]), k, want)]


def test_expansion_without_anchors_begins_with_the_most_important(spark):
    df, rows = samples(spark)
    none = df.select("sample_id", "idx", F.lit(1).alias("place")).where("false")
    picked = merging.expand_by_importance(df, none, "sample_id", "idx", "vec", "saliency", F.lit(4)).collect()
    for s in range(6):
        own = [r for r in rows if r[0] == s]
        want = expansion_by_loop(np.array([r[4] for r in own]), np.array([r[3] for r in own]), 4, [])
        assert sorted(r.idx for r in picked if r.sample_id == s) == want and not any(r.is_anchor for r in picked)


def test_merge_lineage_covers_every_token(spark):
    df, rows = samples(spark)
    out = merging.contextual_merge(df, "sample_id", "idx", "saliency", "vec", "vec", keep_count(F.col("n"), 0.4)).collect()
    for s in range(6):
        own, kept = [r for r in rows if r[0] == s], [r for r in out if r.sample_id == s]
        contextual = [r for r in kept if r.role == "contextual"]
        covered = sorted([r.idx for r in kept] + [i for r in kept for i in r.merged])
        # everything that isn't dominant goes somewhere, unless nothing is contextual
        assert covered == list(range(len(own))) if contextual else covered == sorted(r.idx for r in kept)
        for r in kept:
            v = np.array([x[4] for x in own])
            assert np.allclose(r.vec, v[r.idx] + (v[r.merged].mean(axis=0) if r.merged else 0))
    split = spark.createDataFrame([(k,) for k in (1, 2, 3, 16, 64)], "k int").select("k", merging.budget_split(F.col("k")).alias("b")).collect()
    assert {r.k: (r.b.dominant, r.b.contextual) for r in split} == {1: (1, 0), 2: (2, 0), 3: (2, 1), 16: (14, 2), 64: (54, 10)}


def orthogonal_by_loop(v, k, alpha=0.5, beta=0.5):
    """Residuals by least squares on the picked directions, in place of a running basis."""
    u, length = unit(v), np.linalg.norm(v, axis=1)
    spread = lambda x: (x - x.min()) / (x.max() - x.min()) if np.ptp(x) > 1e-12 else np.zeros(len(x))
    worth, picked = beta * spread(length) + (1 - beta) * spread(np.zeros(len(v))), []
    for _ in range(min(k, len(v))):
        if picked:
            basis = np.linalg.svd(u[picked].T, full_matrices=False)
            q = basis[0][:, basis[1] > 1e-9]
            spanned = np.minimum(1, ((u @ q) ** 2).sum(axis=1))
        else:
            spanned = np.zeros(len(v))
        gain = (alpha * np.sqrt(np.maximum(0, 1 - spanned)) + (1 - alpha) * worth).round(9)
        gain[picked] = -np.inf
        picked.append(int(np.argmax(gain)))
    return picked


def test_sequential_selectors_against_loops(spark):
    tokens = inputs.tokens(spark, "/root/testdata/sf0.001")
    rows = tokens.orderBy("sample_id", "idx").collect()
    for name, loop in (("orthogonal", lambda v, r: orthogonal_by_loop(v, 8)), ("anchor_novelty", None)):
        got = {}
        for r in sorted(greedy.run_selector(tokens, name, 8).collect(), key=lambda r: (r.sample_id, r.step)):
            got.setdefault(r.sample_id, []).append(r.idx)
        for s in {r.sample_id for r in rows}:
            own = [r for r in rows if r.sample_id == s]
            v, relevance = np.array([r.vec for r in own]), np.array([r.relevance for r in own])
            if loop:
                want = loop(v, relevance)
            else:  # half by relevance, then whatever is farthest from all that is picked
                want = sorted(range(len(own)), key=lambda i: (-relevance[i], i))[: max(1, round(0.5 * min(8, len(own))))]
                while len(want) < min(8, len(own)):
                    far = {i: min(1 - unit(v[i]) @ unit(v[j]) for j in want) for i in range(len(own)) if i not in want}
                    want.append(max(far, key=lambda i: (round(far[i], 12), -i)))
            assert got[s] == [own[i].idx for i in want], (name, s)
