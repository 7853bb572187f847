"""Selectors as plans against the loops that they stand for, sample by sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions.maths import keep_count
from evalweave.operators import staged

from . import selector_loops

KIND = "sample_id int, idx int, x1 double, y1 double, x2 double, y2 double, relevance double, uniqueness double, regions array<struct<x1:double,y1:double,x2:double,y2:double>>"


def samples():
    rng, rows = np.random.default_rng(5), []
    for s, (n, regions, low) in enumerate([(1, 0, -1), (2, 1, 0), (9, 2, -1), (25, 3, -1), (25, 0, 0.5), (30, 2, 0.5), (30, 2, -2), (16, 1, -1), (40, 4, -1)]):
        at = rng.random((n, 2)) * 0.9
        size = rng.random((n, 2)) * 0.1 + 0.02
        relevance = rng.integers(0, 8, n) / 4 + low if s != 6 else -rng.random(n)
        found = [tuple(map(float, (*c, *(c + rng.random(2) * 0.3 + 0.05)))) for c in rng.random((regions, 2)) * 0.6] or None
        for i in range(n):
            rows.append((s, 3 * i, *map(float, at[i]), *map(float, at[i] + size[i]), float(relevance[i]), float(rng.integers(0, 5)), found))
    return rows


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame(samples(), KIND).cache()


@pytest.mark.parametrize("name", staged.NAMES)
def test_selectors_against_loops(tokens, name):
    rows = tokens.toPandas()
    tried = tokens.select("*", F.explode(F.array(*map(F.lit, [0.1, 0.3, 0.5, 1.0]))).alias("ratio"))
    got = {}
    for r in staged.select(tried, name, "sample_id", "idx", keep_count(F.col("_n"), F.col("ratio")), by=["sample_id", "ratio"]).collect():
        got.setdefault((r.sample_id, r.ratio), []).append((r.step, r.idx))
    for (s, own), ratio in ((x, r) for x in rows.groupby("sample_id") for r in (0.1, 0.3, 0.5, 1.0)):
        own = own.sort_values("idx").reset_index(drop=True)
        t = selector_loops.tokens_of(own, f"{name}:{s}")
        k = max(1, min(t.n, int(np.ceil(round(t.n * ratio, 9)))))
        want = selector_loops.SELECTORS[name](t, k)
        found = sorted(got[s, ratio])
        assert [step for step, _ in found] == list(range(1, k + 1))
        assert sorted(i for _, i in found) == sorted(own.idx[want]), (name, s, ratio)
        if k < t.n and name != "coverage_greedy":
            assert [i for _, i in found] == own.idx[want].tolist(), (name, s, ratio)


def test_unknown_names(tokens):
    with pytest.raises(ValueError):
        staged.select(tokens, "nothing", "sample_id", "idx", F.lit(1))


def test_one_shuffle_for_all_stages(tokens):
    plan = staged.select(tokens, "hybrid", "sample_id", "idx", F.lit(5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
