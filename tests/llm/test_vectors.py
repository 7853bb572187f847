import math
import random

import numpy as np

from evalweave.llm.learned_partitions import balanced_parts, neighbour_graph, search
from evalweave.llm.maxscore import maxscore, top_k

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=600, d=16, hot=150):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[:hot] = x[0]  # a large group of equal vectors: ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [1.0] * (d - 1) + [None], 0), (n + 2, [float("nan")] * d, 0), (n + 3, [math.inf] * d, 0), (n + 4, [0.0] * d, 0), (None, [1.0] * d, 0)]
    return spark.createDataFrame(rows + odd, VEC), x


def test_top_k_equals_brute_force(spark):
    df, x = vectors(spark)
    w = np.floor(1024 * np.vstack([x, np.zeros((1, 16))]).astype(np.float64)).astype(np.int64)
    ids = np.array([*range(600), 604])
    got = {}
    for r in top_k(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = w @ w[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want[int(ids[q])] = [(k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_top_k_small_tables(spark):
    assert top_k(spark.createDataFrame([], VEC)).count() == 0
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0, 3.0], 0), (1, [2.0, 3.0], 0)], VEC)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(few).collect()) == [(0, 1, 1, 1024 * 2048), (0, 2, 1, 1024 * 2048)]


def test_maxscore_keeps_ties_and_negative_scores():
    rng = random.Random(0)
    for _ in range(200):
        n, d, k = rng.randrange(1, 400), rng.randrange(1, 6), 3
        x = np.array([[rng.randrange(-3, 4) for _ in range(d)] for _ in range(n)], dtype=np.int64)
        q = np.array([rng.randrange(-3, 4) for _ in range(d)], dtype=np.int64)
        ids = np.arange(n)
        found, score = maxscore(q, 0, np.ascontiguousarray(x.T), ids, x.max(axis=0), x.min(axis=0), k)
        s = x @ q
        want = [i for i in np.lexsort((ids, -s)) if i != 0][:k]
        top = np.lexsort((found, -score))[:k]
        assert found[top].tolist() == want and score[top].tolist() == s[want].tolist()


def test_search_recall_and_exact_scores(spark):
    df, x = vectors(spark, n=1500, hot=200)
    x = x.astype(np.float64)
    got = {}
    for r in search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [int(i) for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(v - s[i]) < 1e-9 for _, i, v in rows)
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(rows[:-1], rows[1:]))
        hits, total = hits + len(set(want) & {r[1] for r in rows}), total + 20
    assert hits / total >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_search_lengths_repeats_and_long_ties(spark):
    """With every part probed the search is exact: vectors of several lengths, repeated ids, more ties than k."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5 if i % 3 else 3).tolist(), 0) for i in range(300)] + [(40, [1.0] * 5, 0)] * 30 + [(i, [2.0, 1.0, 1.0, 1.0, 1.0], 0) for i in range(400, 500)] + [(20, rng.normal(size=7).tolist(), 0)]
    rows += [(300, [0.0] * 5, 0), (301, [], 0), (302, [math.nan], 0)]
    x = np.zeros((len(rows) - 3, 7))
    for i, (_, v, _) in enumerate(rows[:-3]):
        x[i, : len(v)] = v
    ids = np.array([r[0] for r in rows[:-3]])
    got = {}
    for r in search(spark.createDataFrame(rows, VEC).repartition(5), share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        own = min((rows[i][1], x[i].tolist()) for i in np.flatnonzero(ids == q))[1]
        score = np.zeros(len(ids))
        for d in range(7):
            score += x[:, d] * own[d]
        want = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [r[1] for r in sorted(found)] == ids[want].tolist() and np.allclose([r[2] for r in sorted(found)], score[want])


def test_search_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = df.select("vec_id", "embedding").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_list()).astype(np.float64)
    got, hits, total = {}, 0, 0
    for r in search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != i][:20]
        hits, total = hits + len(got[int(ids[i])] & set(want)), total + len(want)
    assert hits / total >= 0.9, hits / total


def test_search_small_tables(spark):
    assert search(spark.createDataFrame([], VEC)).count() == 0
    few = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(5)], VEC)
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(800, 8))
    label = balanced_parts(neighbour_graph(x, 10), 8, np.random.default_rng(0))
    near = neighbour_graph(x, 10)
    assert np.bincount(label, minlength=8).max() <= math.ceil(800 / 8 * 1.1) and (label[near] == label[:, None]).mean() > 0.25
