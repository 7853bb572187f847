import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalweave.llm import components, jaccard_join
from evalweave.llm.components import connected_components
from evalweave.llm.jaccard_join import Bands, distinct_documents, jaccard_groups, sketches
from evalweave.llm.shingles import shingle_sets

from .fixtures import DOC, awkward, empty, prose


def shingles(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, percent=90, width=3):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return {i: (len(sets[i]), group[i]) for i in sets}


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs.withColumn("node", F.lit(1)).withColumn("band", F.lit("x"))).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got.pop(None) == (1, None) and got == want
    assert want[13] == (118, 0) and want[2][1] == 0 and want[8][1] == 7


def test_repeated_and_empty(spark):
    docs = awkward(spark).where("doc_id in (0, 5)")
    assert sorted(jaccard_groups(docs.unionByName(docs)).select("doc_id", "component_id").collect()) == [(0, 0), (0, 0), (5, 5), (5, 5)]
    assert jaccard_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_crowded_buckets_against_brute_force(spark, monkeypatch, percent):
    """Chains of edits of one text: near and not near copies share most words; blocks are tiny, so that they are split."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    rng, rows = random.Random(3), []
    for g in range(3):
        text = prose(g, 60 + 40 * g).split(" ")
        for k in range(40):
            own = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(own)))
    rows += [(1000 + n, prose(77, n)) for n in range(1, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs, percent=percent).collect()}
    assert got == brute(rows, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_sketches_bound_the_difference_and_places_meet(percent):
    rng = np.random.default_rng(0)
    bands = Bands(percent)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        n, gone = len(a), rng.integers(0, max(1, len(a) // 6) + 1)
        b = np.unique(np.concatenate([a[: n - gone], rng.integers(0, 2**63, rng.integers(0, max(1, n // 6) + 1)).astype(np.uint64)]))
        difference = len(set(a.tolist()) ^ set(b.tolist()))
        if not len(b) or not difference or 100 * len(set(a.tolist()) & set(b.tolist())) < percent * len(set(a.tolist()) | set(b.tolist())):
            continue
        asked = [(i, band, bands.places(band), most) for i, x in enumerate((a, b)) for band, most in bands.wanted(len(x))]
        made = {(i, band): out for (i, band, _, _), out in zip(asked, sketches([a, b], asked), strict=True)}
        band = bands.of(min(len(a), len(b)))
        distance = int(np.bitwise_count(made[0, band][0] ^ made[1, band][0]).sum())
        assert distance <= difference and set(made[0, band][1].tolist()) & set(made[1, band][1].tolist())


def test_repeated_ids_in_any_order(spark):
    """Two texts of one doc_id, each with a near copy: all are one group, however the rows lie."""
    one, two = prose(1, 200), prose(2, 200)
    near = lambda t: t.replace(" w", " changed w", 1)
    rows = [(5, one), (5, two), (7, near(one)), (8, near(two)), (5, one), (3, prose(3, 50))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(3)
        assert {(r.doc_id, r.component_id) for r in jaccard_groups(docs).collect()} == {(5, 5), (7, 5), (8, 5), (3, 3)}
        kept = distinct_documents(docs, percent=90, width=3).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([(3, prose(3, 50)), (5, one), (5, two)])


def test_distinct_documents_keeps_columns_and_nulls(spark):
    docs = awkward(spark).withColumn("h1", F.lit(1)).withColumn("none", F.lit(2)).withColumn("own_id", F.lit(3)).withColumn("place", F.lit(4))
    kept = distinct_documents(docs.unionByName(docs.where("doc_id in (0, 9)")), percent=90, width=3)
    assert kept.dtypes == docs.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "3", "4", "5", "6", "7", "9", "10", "11", "12", "None"])
    alone = spark.createDataFrame([(None, prose(5, 90), "en", "s", 0), (4, prose(5, 90), "en", "s", 0), (None, prose(6, 90), "en", "s", 0)], DOC)
    assert sorted(str(r.doc_id) for r in distinct_documents(alone).collect()) == ["4", "None"]
    assert distinct_documents(empty(spark)).count() == 0


def test_long_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement: equal for every polynomial modulo 2**64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word, "en", "s", 0), (2, other, "en", "s", 0), (3, word.upper(), "en", "s", 0)], DOC)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_groups(docs).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_long_texts_in_pieces():
    rng = random.Random(1)
    for text in (prose(9, 4000, 900), "x" * 5000, " " * 3000 + prose(2, 40) + "\t" + "y" * 700 + " z " * 300, "é" * 400 + " " + "A" * 10, " ".join("q" * rng.randrange(1, 200) for _ in range(300))):
        whole = next(shingle_sets(pa.array([text])))[1][0]
        for size in (7, 64, 500):
            assert next(shingle_sets(pa.array([text]), step_bytes=size))[1][0].tolist() == whole.tolist()


@pytest.mark.parametrize("edges_a_task", [20, 1 << 18])
def test_components(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(components, "TASK_EDGES", edges_a_task)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (900, 901), (901, 900)] + [(2000, i) for i in range(2001, 2300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900} | {i: 2000 for i in range(2000, 2300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
