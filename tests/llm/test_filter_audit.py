import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evalweave.llm import filter_audit
from evalweave.llm.filter_audit import audit, audit_documents, edge_counts, labelled, measured, standard_filters

from .fixtures import awkward, empty, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order applied to the rows themselves, filter by filter."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q if k else t) == 1} for k in (1, 0))
    rows = [(i, t or "", lang or "") for i, t, lang in rows]

    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = "A" if len(words) < 100 else ""
        found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
        found += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        found += "D" if re.search("[#$%&*|]", text) else ""
        return found + ("E" if i is not None and any(j is not None and j < i and u == text for j, u, _ in rows) else "")

    marked = [(i, part, fails(i, text)) for i, text, part in rows]
    out, shapley = {}, {}
    for part in {p for _, p, _ in marked}:
        for order in permutations("ABCDE"):
            left = [r for r in marked if r[1] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                every = [r for r in marked if r[1] == part and f in r[2]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out[part, "".join(order), step] = (f, len(left), len(gone), len(every) - len(gone), sum(r[2] == f for r in every), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order_against_the_rows_themselves(spark):
    docs = awkward(spark)
    long = [(20, prose(3, 150, 40), "en"), (21, prose(3, 150, 40), "en"), (22, " ".join(f"u{i}" for i in range(120)) + " #1", "fr"), (23, " ".join(f"U{i}" for i in range(120)), "fr"), (24, " ".join(f"U{i}" for i in range(120)), "en"), (24, "again", "de"), (None, "again", "de"), (25, "again", "de")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, s, "s", 0) for i, t, s in long], docs.schema))
    docs = docs.unionByName(docs.where("doc_id in (0, 4, 5)"))
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (22, 1, 1), (24, None, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0)]
    odd = docs.withColumn("Part", F.lit(1)).withColumn("words", F.lit("x")).withColumn("good", F.lit(2)).withColumn("a`b", F.lit(3)).withColumn("_metadata", F.lit(4))
    got = found(audit_documents(odd, spark.createDataFrame(labels, LABELS).withColumn("doc_ID_", F.lit(0)).withColumn("Good", F.lit(1))))
    want = brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert got == want
    assert len({k[0] for k in got}) == 4 and any(v[1] == 0 for v in got.values())


def test_states_are_shared_and_counts_are_of_survivors(spark):
    rows = labelled(measured(awkward(spark)), spark.createDataFrame([], LABELS))
    filters = {k: v for k, v in standard_filters().items() if k in "ACE"}
    edges = edge_counts(rows, filters)
    seen = [(r.state, r.filter, r.part) for r in edges.select("state", "filter", "part").collect()]
    assert len(seen) == len(set(seen)) and {s for s, _, _ in seen} == set(range(7))
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert audit(rows, filters).count() == 6 * 3 * 4
    with pytest.raises(ValueError):
        edge_counts(rows, {})


def test_measures(spark):
    rows = spark.createDataFrame([(1, "Aé B\x0bA x  #"), (2, None), (3, ""), (4, "🙂" * 3), (5, "x" * 300_000 + " y" * 100_000), (None, "")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: tuple(r)[1:] for r in measured(rows).collect()}
    assert got == {1: ("", 4, 4, 3, 11, True, False), 2: ("", 0, 0, 0, 0, False, False), 3: ("", 0, 0, 0, 0, False, True), 4: ("", 1, 1, 0, 3, False, False), 5: ("", 100_001, 2, 0, 500_000, False, False), None: ("", 0, 0, 0, 0, False, False)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    out = audit_documents(empty(spark), none)
    assert out.count() == 0 and dict(out.dtypes)["shapley"] == "bigint" and dict(out.dtypes)["step"] == "int"
    assert audit_documents(awkward(spark).where("doc_id = 12"), none).where("shapley > 0").count() == 120


def test_no_python_on_the_way(spark):
    plan = measured(awkward(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and filter_audit.MOST_FILTERS == 7
