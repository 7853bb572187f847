import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import minhash_forest
from evalweave.llm.minhash_forest import HASHES, Strings, bit_string, can_link, levels, minhash_groups, signature, sorted_orders

from .fixtures import DOC, awkward, empty, prose
from .test_joins import brute


def found(docs, **kind):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_groups(docs, **kind).collect()}


def test_awkward_documents(spark):
    docs = awkward(spark)
    odd = docs.withColumn("NODE", F.lit(1)).withColumn("sig", F.lit("x")).withColumn("a`b", F.lit(2)).withColumn("_metadata", F.lit(3))
    rows = minhash_groups(odd, percent=85, width=3).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 85)
    assert got.pop(None) == (1, None) and got == want
    assert {r.doc_id: r.kept for r in rows} == {i: g == i for i, (_, g) in want.items()} | {None: True}


def test_repeated_and_empty(spark):
    docs = awkward(spark).where("doc_id in (0, 5)")
    again = minhash_groups(docs.unionByName(docs), percent=85, width=3).select("doc_id", "component_id", "kept")
    assert sorted(again.collect()) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True)]
    assert minhash_groups(empty(spark)).count() == 0
    one, two = prose(1, 200), prose(2, 200)
    near = lambda t: t.replace(" w", " changed w", 1)
    rows = [(5, one), (5, two), (7, near(one)), (8, near(two)), (3, prose(3, 50))]
    assert {i: g for i, (_, g) in found(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).items()} == {5: 5, 7: 5, 8: 5, 3: 3}


def edited(groups, each, vocabulary=10**6):
    """Groups of edits of one text, about the threshold on both sides."""
    rng, rows = random.Random(3), []
    for g in range(groups):
        text = prose(g, 60 + 40 * g).split(" ")
        for k in range(each):
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(vocabulary)}"
            rows.append((g * 1000 + k, " ".join(own)))
    return rows + [(10_000 + n, prose(77, n)) for n in range(1, 40)]


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5)])
def test_edits_against_brute_force(spark, percent, width):
    rows = edited(3, 40)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    assert found(docs, percent=percent, width=width) == brute(rows, percent, width)


def test_every_level_and_tiny_blocks(spark, monkeypatch):
    """Blocks of a few nodes, so that regions are crowded, go to deeper levels and are split there."""
    monkeypatch.setattr(minhash_forest, "BLOCK", 5)
    monkeypatch.setattr(minhash_forest, "VISITORS", 3)
    monkeypatch.setattr(minhash_forest, "ROWS_A_MEMBER", 1)
    rows = edited(2, 50)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    deep = []
    keys = minhash_forest.order_keys
    monkeypatch.setattr(minhash_forest, "order_keys", lambda n, d, c: deep.append(d) or keys(n, d, c))
    assert found(docs, percent=85, width=3) == brute(rows, 85)
    assert deep == [3, 6, 12]


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_signatures_agree_as_sets_do(percent):
    """Pairs at the threshold share a region and agree in enough places; unlike ones agree in few."""
    rng = np.random.default_rng(percent)
    depth, count = levels(percent)[0]
    heads = np.array([o[:depth] for o in sorted_orders(depth, count)])
    shares = []
    for size in (20, 200, 3000):
        for _ in range(60):
            both = round(size * percent / 100)
            pool = np.unique(rng.integers(0, 2**63, size + 50).astype(np.uint64))
            rng.shuffle(pool)
            a, b = pool[:both + (size - both) // 2], np.concatenate([pool[:both], pool[both + (size - both) // 2 : size]])
            x, y = signature(a), signature(b)
            match = x == y
            shares.append(match.mean())
            assert match[heads].all(axis=1).any()
            strings = Strings(pa.array([bit_string(v).view(np.int64) for v in (a, b)]))
            w = int(strings.words.min())
            distance = np.bitwise_count(strings.of(np.array([0]), w) ^ strings.of(np.array([1]), w)).sum()
            differ = len(set(a.tolist()) ^ set(b.tolist()))
            assert distance <= differ and (size < 200 or distance > 0.7 * differ) and (can_link(distance, len(a), len(b), percent) or len(set(a.tolist()) & set(b.tolist())) * 100 < percent * (len(a) + len(b) - len(set(a.tolist()) & set(b.tolist()))))
    assert abs(np.mean(shares) - percent / 100) < 0.02
    assert (signature(pool[: len(pool) // 2]) == signature(pool[len(pool) // 2 :])).sum() < HASHES // 10


def test_orders_and_levels():
    assert [d for d, _ in levels(85)] == [3, 6, 12] and levels(100) == [(3, 1), (6, 1), (12, 1)]
    heads = [c for o in sorted_orders(3, 15) for c in o[:3]]
    assert len(set(heads)) == 45 and all(len(set(o)) == 12 for o in sorted_orders(3, 15))
    with pytest.raises(ValueError):
        minhash_groups(None, percent=40)
