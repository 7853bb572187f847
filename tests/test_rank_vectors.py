"""Sums of ranks under the draws, as vectors over the replicates, against loops."""

import numpy as np
import pytest

from evalweave.operators import correlations, ordered


@pytest.mark.parametrize("bucket_rows", [5, 1_000_000])
def test_ranks_of_all_draws_over_many_buckets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 == 0 else "g", i % 70, float(rng.integers(0, 9) - 4) * (1.0 if i % 2 else -1.0), float(rng.normal()), float(rng.integers(0, 3))) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, u long, x double, y double, z double").repartition(3)
    sums, value = correlations.cross_products(df, ["g"], "u", ["y"], ["x", "y", "z"], 12, 0)
    got = {(r.g, r.replicate): r for r in sums.select("*", value[1, 2].alias("r")).collect()}
    weights = {(r.u, r.replicate): r.w for r in correlations.with_replicates(df.select("u").distinct(), "u", 12, 0).collect()}
    for g in (None, "g"):
        own = [r for r in rows if r[0] == g]
        for b in range(13):
            w = np.array([weights.get((r[1], b), 0) for r in own], float)
            ranks = []
            for c in (2, 3, 4):
                v = np.array([r[c] for r in own])
                ranks.append(np.array([w[v < t].sum() + (w[v == t].sum() + 1) / 2 for t in v]))
            columns = [np.array([r[3] for r in own]), *ranks]
            found = got[g, b]
            assert found["_w"] == w.sum()
            for i, p in enumerate(columns):
                assert found[f"_s{i}"] == pytest.approx((w * p).sum(), abs=1e-6)
                for j in range(i, 4):
                    assert found[f"_p{i}_{j}"] == pytest.approx((w * p * columns[j]).sum(), abs=1e-6)
            keep = np.repeat(np.arange(len(w)), w.astype(int))
            assert found.r == pytest.approx(np.corrcoef(ranks[0][keep], ranks[1][keep])[0, 1], abs=1e-9)


def test_rows_are_not_multiplied_by_draws(spark):
    """No row a unit and draw is made: what replicates explode is sums of tasks."""
    rows = spark.range(50).selectExpr("id u", "double(id % 7) x", "double(id % 5) y")
    plan = correlations.partial_spearman_interval(rows, "x", "y", [], [], "u")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == plan.count("posexplode(") == 1


@pytest.mark.parametrize("bucket_rows", [100, 1_000_000])
def test_groups_of_a_bucket_need_no_vectors(spark, monkeypatch, bucket_rows):
    """Ranks of a group that a task holds come without a join; a larger group beside it still goes by vectors, with the same sums, and more than one block of replicates keeps its numbers."""
    rows = spark.range(200).selectExpr("if(id < 150, 'large', 'small') g", "id % 90 u", "double(id % 7) x", "double(id % 5) y")
    sums = lambda: correlations.cross_products(rows, ["g"], "u", ["y"], ["x", "y"], 70, 0)[0]
    cells = lambda df: {(r.g, r.replicate): r for r in df.collect()}
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 10)
    want = cells(sums())
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket_rows)
    found = sums()
    assert ("_twice" not in found._jdf.queryExecution().optimizedPlan().toString()) == (bucket_rows > 150)
    got = cells(found)
    assert set(got) == set(want) and {b for _, b in got} == set(range(71))
    for k, r in want.items():
        assert [got[k][c] for c in found.columns if c.startswith(("_w", "_s", "_p"))] == pytest.approx([r[c] for c in found.columns if c.startswith(("_w", "_s", "_p"))], abs=1e-6)
