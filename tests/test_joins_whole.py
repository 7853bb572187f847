"""Joins on any of several keys and on shared tokens give every pair, once."""

import re

from pyspark.sql import functions as F

from evalweave.functions import text
from evalweave.operators import joins
from evalweave.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_every_pair_of_a_nation_or_a_balance_is_there(spark):
    """Ids that repeat, with several values of a key, nulls and pairs that agree twice."""
    left = [(1, 1, 5), (1, 2, 5), (1, 2, 7), (2, None, 5), (3, 3, None), (4, 9, 9), (None, 1, 1)]
    right = [(10, 2, 5), (10, 1, 7), (11, 3, 5), (12, None, None), (13, 8, 7), (None, 8, 9)]
    want = {(a, b) for a, x, y in left for b, u, v in right if x is not None and x == u or y is not None and y == v}
    schema = lambda i: f"{i} long, x int, y long"
    keys = [("x", F.col("x"), F.col("x")), ("y", F.col("y"), F.col("y"))]
    got = [tuple(r) for r in joins.any_key(spark.createDataFrame(left, schema("a")), spark.createDataFrame(right, schema("b")), "a", "b", keys).collect()]
    assert len(got) == len(want) and set(got) == want


def test_customers_meet_every_supplier_of_their_nation(spark):
    rows = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "supplier")}
    pairs = rows["customer"].join(rows["supplier"], F.col("c_nationkey") == F.col("s_nationkey")).count()
    assert catalog.QUERIES["multi_key_or_join"](spark, DATA).count() >= pairs > 0


def test_a_pair_with_one_common_token_of_many_has_a_row(spark):
    docs = [(1, "a b c"), (1, "c d"), (2, "z"), (3, None), (4, "")]
    items = [(7, "a q r s t u v w"), (8, "z z c"), (9, "none")]
    words = lambda rows, i: set().union(*[re.findall("[a-z0-9]+", t or "") for j, t in rows if j == i])
    want = {(d, i): len(words(docs, d) & words(items, i)) / len(words(docs, d) | words(items, i)) for d in (1, 2) for i in (7, 8, 9) if words(docs, d) & words(items, i)}
    found = joins.shared_tokens(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame(items, "item_id long, text string"), "item_id", text.words(F.col("text")))
    assert {(r.doc_id, r.item_id): r.jaccard for r in found.collect()} == want and (1, 7) in want
