"""Metric tables, their intervals, policies and correlations against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.operators import correlations, metrics, ordered, policies, replicates, sweep


def plain_auc(labels, scores):
    pairs = [(a, b) for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) if pairs else 0.5


def plain_ap(labels, scores, down=True):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i] if down else scores[i], i))
    hits, total = 0, 0.0
    for rank, i in enumerate(order, 1):
        hits += labels[i]
        total += labels[i] * hits / rank
    return total / hits if hits else 0.0


def sample_rows(n=240, seed=3):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "", None]), rng.choice([0.0, 0.0, 1.0, rng.random()]), rng.random(), int(rng.random() < 0.4), int(rng.random() < 0.5)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "i int, g string, tied double, free double, e int, neg int").withColumn("f", F.col("e") * F.col("neg")).repartition(4)


@pytest.mark.parametrize("bucket_rows", [1_000_000, 40])
def test_rollup_against_loops(spark, monkeypatch, bucket_rows):
    """Small buckets cut groups and tied values; nothing changes."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", bucket_rows)
    rows = sample_rows()
    out = sweep.metrics_rollup(frame(spark, rows), ["tied", "free"], "i", F.col("e"), F.col("f"), F.col("neg"), {"group": F.col("g")}, (0.5, 0.8))
    got = {(r.scope, r.cohort, r.risk): r for r in out.collect()}
    assert {k[:2] for k in got} == {("overall", "all"), ("group", "a"), ("group", "b"), ("group", "<empty>")}
    for (scope, cohort, risk), r in got.items():
        own = [x for x in rows if scope == "overall" or (x[1] or "<empty>") == cohort]
        score, e, f, neg = [x[2 if risk == "tied" else 3] for x in own], [x[4] for x in own], [x[4] * x[5] for x in own], [x[5] for x in own]
        near = lambda a, b: abs(a - b) < 1e-12
        assert near(r.error_auroc, plain_auc(e, score)) and near(r.false_alarm_auroc, plain_auc(f, score)) and near(r.inverted_error_auroc, plain_auc(e, [-s for s in score]))
        assert near(r.error_auprc, plain_ap(e, score)) and near(r.inverted_error_auprc, plain_ap(e, score, False)) and near(r.false_alarm_auprc, plain_ap(f, score))
        up = sorted(range(len(own)), key=lambda i: (score[i], i))
        assert near(r.aurc, np.mean([np.mean([e[i] for i in up[: k + 1]]) for k in range(len(up))]))
        for c in (50, 80):
            k = max(1, math.ceil(round(len(own) * c / 100, 9)))
            held = [f[i] for i in up[:k] if neg[i]]
            assert near(r[f"error_{c}"], np.mean([e[i] for i in up[:k]])) and near(r[f"hfpr_{c}"], np.mean(held) if held else 0.0) and near(r[f"accuracy_{c}"], 1 - r[f"error_{c}"])
            down = sorted(range(len(own)), key=lambda i: (-score[i], i))
            assert near(r[f"inverted_error_{c}"], np.mean([e[i] for i in down[:k]]))


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rollup_shuffles_no_row_a_risk_and_scope(spark):
    """Rows are dealt once; what else moves are sums of equal values."""
    rows, risks = spark.range(20_000).select("id", (F.col("id") % 7 / 7).alias("v"), (F.col("id") % 3 == 0).alias("e")), [f"r{i}" for i in range(6)]
    before = shuffled_rows(spark)
    out = sweep.metrics_rollup(rows.withColumns({r: F.col("v") for r in risks}), risks, "id", F.col("e"), F.col("e"), F.lit(True), {"g": F.col("id") % 2}).collect()
    assert len(out) == 18 and {(r.scope, r.n) for r in out} == {("overall", 20_000), ("g", 10_000)}
    assert shuffled_rows(spark) - before < 40_000


def test_a_value_of_half_of_the_rows_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 100)
    rows = spark.range(2000).select((F.col("id") % 2).alias("v"), "id")
    found = ordered.running(rows, [], "v", ["id"], {"s": F.lit(1)})
    assert {(r.rn, r.s) for r in found.select("rn", "s").collect()} == {(k, k) for k in range(1, 2001)}
    sizes = ordered.bucketed(rows, ordered.order_key(rows, "v", [F.col("id")], False), [], [], 100).groupBy("_bucket").count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) < 400


def test_order_of_nulls_and_nan(spark):
    rows = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, -1.0), (5, float("inf"))], "i int, v double")
    for down, want in ((False, [1, 4, 3, 5, 2]), (True, [2, 5, 3, 4, 1])):
        assert [r.i for r in ordered.running(rows, [], "v", ["i"], {}, descending=down).orderBy("rn").collect()] == want


def test_intervals_against_explicit_draws(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 50)
    monkeypatch.setattr(replicates, "BLOCK", 7)
    rows, n = sample_rows(150), 40
    out = replicates.bootstrap_risk_table(frame(spark, rows), ["tied", "free"], "i", F.col("e"), F.col("f"), F.col("neg"), [5, F.col("i")], 0.7, n)
    got = {(r.risk, r.metric): r for r in out.collect()}
    seeds = spark.createDataFrame([(x[0],) for x in rows], "i int").select("i", *[c.alias(k) for k, c in zip("ab", replicates.key_seeds(5, F.col("i")), strict=True)]).toPandas().sort_values("i")
    weight = replicates.draws(seeds.a.to_numpy(), seeds.b.to_numpy(), n).astype(int)
    assert set(weight[:, 0]) == {1} and 0.9 < weight[:, 1:].mean() < 1.1
    for risk in ("tied", "free"):
        each = {m: [] for m in ("error_auroc", "false_alarm_auroc", "accuracy_70", "hfpr_70")}
        for b in range(n + 1):
            drawn = [x for x, w in zip(rows, weight[:, b].tolist()) for _ in range(w)]
            score, e, f, neg = [x[2 if risk == "tied" else 3] for x in drawn], [x[4] for x in drawn], [x[4] * x[5] for x in drawn], [x[5] for x in drawn]
            up = sorted(range(len(drawn)), key=lambda i: (score[i], drawn[i][0]))[: max(1, math.ceil(round(len(drawn) * 0.7, 9)))]
            held = [f[i] for i in up if neg[i]]
            for m, v in zip(each, (plain_auc(e, score), plain_auc(f, score), 1 - np.mean([e[i] for i in up]), np.mean(held) if held else 0.0)):
                each[m].append(v)
        for m, v in each.items():
            r = got[risk, m]
            assert np.allclose([r.estimate, r.mean, r.low, r.high, r.draws], [v[0], np.mean(v[1:]), *np.quantile(v[1:], [0.025, 0.975]), n])


def test_policies_against_loops(spark):
    rng = random.Random(0)
    budgets = (0.3, 0.5, 0.7)
    rows = [(i, rng.choice(["dev", "test"]), rng.choice([0.1, 0.4, 0.4, rng.random()]), b, rng.random() < b, rng.random() < 0.3, rng.random() < 0.6, rng.choice([None, float("nan"), rng.random()])) for i in range(80) for b in budgets]
    risk = {i: r for i, _, r, *_ in rows}
    rows = [(i, "dev" if i % 3 else "test", risk[i], *rest) for i, _, _, *rest in rows]
    negative = {i: g for i, *_, g, _ in rows}
    rows = [(*r[:6], negative[r[0]], r[7]) for r in rows]
    df = spark.createDataFrame(rows, "i int, split string, risk double, b double, ok boolean, fp boolean, neg boolean, ecr double")
    weights = {"hfpr": 0.5, "keep": 0.2, "cascade": 0.1, "ecr": 0.3}
    out = policies.policy_sweep(df, policies.fixed_cuts(spark, [0.4, 0.2, 0.4, 0.9]), [(0.3, 0.5, 0.7), (0.3, 0.5, 0.5)], "split", "risk", "b", F.col("ok"), F.col("fp"), F.col("neg"), F.col("ecr"), weights, 0.1).collect()
    assert len(out) == 2 * 2 * 6
    scores = {}
    for r in out:
        own = [x for x in rows if x[1] == r.split and x[3] == (r.high if x[2] >= r.hi else r.mid if x[2] >= r.lo else r.base)]
        cost = lambda b: r.base + (b if b > r.base else 0)  # noqa: B023, E731
        negatives = [x for x in own if x[6]]
        want = [len(own), np.mean([x[4] for x in own]), np.mean([x[5] for x in negatives]), np.mean([x[3] for x in own]), np.mean([cost(x[3]) for x in own]), np.mean([x[7] if x[7] is not None and x[7] == x[7] else 0 for x in own])]
        assert np.allclose([r.n, r.accuracy, r.hfpr, r.keep, r.cascade, r.ecr], want)
        assert np.isclose(r.mid_rate, np.mean([r.lo <= x[2] < r.hi for x in own])) and np.isclose(r.high_rate, np.mean([x[2] >= r.hi for x in own]))
        goal = want[1] - 0.5 * max(0, want[2] - 0.1) - 0.2 * want[3] - 0.1 * want[4] + 0.3 * want[5]
        assert np.isclose(r.objective, goal)
        if r.split == "dev":
            scores[r.base, r.mid, r.high, r.lo, r.hi] = round(goal, 9)
    best = min(scores, key=lambda k: (-scores[k], k))
    assert {(r.base, r.mid, r.high, r.lo, r.hi) for r in out if r.chosen} == {best}


def test_quantiles_of_counted_values(spark):
    values = [3.0, 1.0, 1.0, 2.5, 7.0, 7.0, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    qs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = metrics.linear_quantiles(df, "v", qs).first()[0]
    assert np.allclose(got, sorted({float(x) for x in np.quantile([v for v in values if v is not None], qs).round(12)}))


def test_conformal_selection_relaxes(spark):
    """Feasible with a cheap threshold, and infeasible: every sample loses much."""
    rows = [("good", s, i / 40, 0.5, 0.5 + (0.3 if i > 36 else 0)) for s in ("dev", "test") for i in range(40)] + [("bad", s, i / 40, 0.2, 0.9) for s in ("dev", "test") for i in range(40)] + [("alone", "dev", 0.5, 0.1, 0.1)]
    out = {(r.task, r.epsilon): r for r in policies.conformal_selection(spark.createDataFrame(rows, "t string, s string, r double, a double, b double"), "t", "s", "r", "a", "b", [0.01, 0.9]).collect()}
    assert out["good", 0.01].feasible and out["good", 0.01].threshold == 37 / 40 and out["good", 0.01].go and out["good", 0.01].dev_upper == 0.0 and abs(out["good", 0.01].dev_cost - (0.3 + 0.7 * 3 / 40)) < 1e-12
    assert not out["bad", 0.01].feasible and not out["bad", 0.01].go and out["bad", 0.01].dev_cost < 0.7 and out["bad", 0.9].feasible and not out["bad", 0.01].threshold == out["bad", 0.9].threshold
    assert out["alone", 0.01].feasible and out["alone", 0.01].test_n == 0 and out["alone", 0.01].test_cost == 0.0


def weighted_ranks(x, w):
    return np.array([w[x < v].sum() + (w[x == v].sum() + 1) / 2 for v in x])


def weighted_corr(x, y, w):
    x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
    size = math.sqrt((w * x * x).sum() * (w * y * y).sum())
    return (w * x * y).sum() / size if size > 1e-9 else math.nan


def test_correlations_against_loops(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"u": range(60), "x": rng.integers(0, 6, 60).astype(float), "z": rng.normal(size=60).round(2), "flat": 1.0})
    data["y"] = data.x + rng.normal(size=60).round(1)
    df = spark.createDataFrame(data).withColumn("y", F.when(F.col("u") % 7 != 0, F.col("y")))
    got = {(r.predictor, r.method): r for r in correlations.correlation_grid(df, [], "u", ["x", "flat"], ["y"], n=30).collect()}
    assert math.isnan(got["flat", "pearson"].estimate) and got["flat", "spearman"].draws == 0
    own = data[data.u % 7 != 0]
    drawn = {(r.u, r.replicate): r.w for r in correlations.with_replicates(df.select("u"), "u", 30, 0).collect()}
    for method in ("spearman", "pearson"):
        each = []
        for b in range(31):
            w = np.array([drawn.get((u, b), 0) for u in own.u], dtype=float)
            x, y, w = own.x.to_numpy()[w > 0], own.y.to_numpy()[w > 0], w[w > 0]
            each.append(weighted_corr(weighted_ranks(x, w), weighted_ranks(y, w), w) if method == "spearman" else weighted_corr(x, y, w))
        r = got["x", method]
        assert r.n == len(own) and np.allclose([r.estimate, r.low, r.high], [each[0], *np.quantile(each[1:], [0.025, 0.975])])
    part = correlations.partial_spearman_interval(df, "x", "y", ["z", "flat"], [], "u", n=5).first()
    ranks = {c: own[c].rank().to_numpy() for c in ("x", "y", "z")}
    design = np.column_stack([np.ones(len(own)), ranks["z"]])
    left = {c: ranks[c] - design @ np.linalg.lstsq(design, ranks[c], rcond=None)[0] for c in ("x", "y")}
    assert abs(part.estimate - np.corrcoef(left["x"], left["y"])[0, 1]) < 1e-9 and part.draws == 5
    few = correlations.partial_spearman_interval(df.where("u < 4"), "x", "y", ["z"], [], "u", n=3).first()
    assert math.isnan(few.estimate) and few.draws == 0


def test_strata(spark):
    rows = [(i, float(i), 1.0 if i < 24 else float(i), float(i % 2)) for i in range(30)]
    got = correlations.strata(spark.createDataFrame(rows, "u int, a double, b double, c double"), [], ["a", "b", "c"]).collect()
    by = {d: {k: [r.u for r in g] for k, g in itertools.groupby(sorted((r for r in got if r.dimension == d), key=lambda r: (r.stratum, r.u)), key=lambda r: r.stratum)} for d in "abc"}
    assert by["a"] == {"small": list(range(10)), "medium": list(range(10, 20)), "large": list(range(20, 30))} and list(by["c"]) == ["constant"]
    assert by["b"] == {"medium": list(range(24)), "large": list(range(24, 30))}  # both thirds are 1: by rank
