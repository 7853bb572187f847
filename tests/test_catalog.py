"""Every catalogue query that SQL can express, against DuckDB on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

from evalweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def cells(rows):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "none"
        return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([[plain(v) for v in r] for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = want.fetchall()
    assert cells([r[c] for c in columns] for r in found.collect()) == cells([r[names.index(c)] for c in columns] for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run_alike_for_any_partitioning(spark, name):
    first = cells(catalog.QUERIES[name](spark, DATA).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and cells(catalog.QUERIES[name](spark, DATA).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_library_does_not_need_the_corpus_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "evalweave.llm" not in path.read_text(), path


def test_every_benchmark_token_counts_as_a_collision(spark, duck):
    """By hand: frequent tokens count as well."""
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    known = set().union(*[words(t) for (t,) in duck.execute("select text from benchmark").fetchall()])
    want = {i: len(words(t) & known) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: r.hits for r in catalog.QUERIES["contamination_collision"](spark, DATA).collect()} == {i: n for i, n in want.items() if n}


def test_documents_are_compared_with_every_benchmark_item(spark, duck):
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    items = {i: words(t) for i, t in duck.execute("select item_id, text from benchmark").fetchall()}
    docs = {i: words(t) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    want = {(d, i): (len(a & b) / len(a | b), len(a & b) / len(a), len(a & b) / len(b)) for d, a in docs.items() for i, b in items.items() if a & b}
    got = {(r.doc_id, r.item_id): (r.jaccard, r.doc_contained, r.item_contained) for r in catalog.QUERIES["token_jaccard"](spark, DATA).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_inference_with_a_thousand_draws(spark):
    assert catalog.QUERIES["two_stage_bootstrap_ci"](spark, DATA).first().draws > 900
    p = catalog.QUERIES["sign_flip_permutation"](spark, DATA).first().p
    assert abs(p * 1001 - round(p * 1001)) < 1e-5 and "1001" in catalog.SQL["hash_bootstrap_ci"]
