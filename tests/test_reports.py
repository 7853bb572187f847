"""Hand-made rows for annotation, trace and feature operators: missing sides, errors, parsing, checkpoints."""

import pytest
from pyspark.sql import functions as F

from evalweave.functions import boxes as bx
from evalweave.functions import features, geometry, relations
from evalweave.operators import annotation, probes, traces

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def value(spark, column, **columns):
    rows = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("_"))
    return rows.select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("[1, 2, 3, 4]", (1, 2, 3, 4)), ("(0.1,0.2,0.3,0.4)", (0.1, 0.2, 0.3, 0.4)), ("1 2 3.5 4", (1, 2, 3.5, 4)), ('{"x": 1, "y": 2, "w": 3, "h": 4}', (1, 2, 4, 6)), ('{"x1": 1, "y1": -2, "x2": 3, "y2": 4e0}', (1, -2, 3, 4)),
        ('{"bbox": [1, 2, 3, 4], "text": "room 5"}', (1, 2, 3, 4)), ('{"text": "5", "box": {"x": 1, "y": 2, "w": 3, "h": 4}}', (1, 2, 4, 6)), ('{"text": "9 9", "vertices": [[3, 1], [1, 5]]}', (1, 1, 3, 5)), ('{"bbox": [1, 2, 3, 4]}', (1, 2, 3, 4)), ('{"polygon": [[3, 1], [1, 5], [2, 2]]}', (1, 1, 3, 5)), ('{"points": [{"x": 3, "y": 1}, {"x": 1, "y": 5}]}', (1, 1, 3, 5)), ("[1, 2, 3]", None), ("no box", None), (None, None),
    ],
)
def test_boxes_from_text(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string")
    got = rows.select(geometry.parsed_box(F.col("t"))).first()[0]
    assert (tuple(got) if got else None) == want


def test_evidence_comes_from_the_first_filled_field_and_the_roles(spark):
    rows = spark.createDataFrame(
        [(["[0, 0, 50, 50]", "bad"], ["[0, 0, 1, 1]"], "", "[0.5, 0.5, 1, 1]", 100.0, 100.0), ([], ["[0, 0, 0.5, 0.5]", "[0, 0, 0.5, 0.5]"], "[0, 0, 0.5, 0.5]", "", 100.0, 100.0), (["[0, 0, 50, 50]"], None, None, None, None, 0.0)],
        "evidence_regions array<string>, ocr_boxes array<string>, subject_bbox string, subj_box string, width double, height double",
    )
    got = rows.select(geometry.evidence_regions(dict(rows.dtypes), F.col("width"), F.col("height")).alias("r")).collect()
    assert [[tuple(b) for b in r.r] for r in got] == [[(0, 0, 0.5, 0.5), (0.5, 0.5, 1, 1)], [(0, 0, 0.5, 0.5)], []]


def test_union_area_against_cells(spark):
    import random

    rng = random.Random(3)
    data = [([tuple(rng.randrange(6) for _ in range(4)) for _ in range(rng.randrange(6))],) for _ in range(60)]
    want = [len({(x, y) for a, b, c, d in bs for x in range(a, c) for y in range(b, d)}) for (bs,) in data]
    rows = spark.createDataFrame([(i, [tuple(map(float, b)) for b in bs]) for i, (bs,) in enumerate(data)], f"i int, b array<{BOX}>")
    assert [r.a for r in rows.select("i", bx.union_area(F.col("b")).alias("a")).orderBy("i").collect()] == want
    assert spark.sql(f"select cast(null as array<{BOX}>) as b").select(bx.union_area(F.col("b"))).first()[0] == 0


def test_greedy_matches_against_a_loop(spark):
    import random

    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.randrange(1, 4), y + rng.randrange(1, 4)))(float(rng.randrange(4)), float(rng.randrange(4)))

    def iou(a, b):
        o = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return o / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - o)

    def loop(a, b):
        left, right, out = set(range(len(a))), set(range(len(b))), []
        while left and right:
            v, i, j = max((iou(a[i], b[j]), i, j) for i in left for j in right)
            left.remove(i), right.remove(j), out.append(v)
        return out

    data = [([box() for _ in range(rng.randrange(4))], [box() for _ in range(rng.randrange(4))]) for _ in range(40)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], f"i int, a array<{BOX}>, b array<{BOX}>")
    got = rows.select("i", geometry.greedy_matches(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [pytest.approx(loop(a, b)) for a, b in data]


def test_annotators_with_a_missing_side_and_nulls(spark):
    schema = f"sample_id int, task string, status string, boxes array<{BOX}>, labels array<string>"
    one = [(0.0, 0.0, 1.0, 1.0)]
    a = spark.createDataFrame([(1, "t", "ok", one, ["x"]), (2, "t", "ok", None, None), (3, "", "ok", one, ["x", "y"])], schema)
    b = spark.createDataFrame([(1, "t", "ok", one, ["x", "x"]), (2, "t", "ok", [], []), (4, "u", None, one, ["x"])], schema)
    got = {r.sample_id: r for r in annotation.compared(a, b).collect()}
    assert [got[k].needs_adjudication for k in (1, 2, 3, 4)] == [0, 1, 1, 1] and got[1].all_boxes_matched_iou == 1 and got[1].union_region_iou == 1
    assert (got[4].present_a, got[4].task, got[4].status_b) == (0, "u", "") and got[3].task == ""
    summary = {(r.scope, r.metric): r.value for r in annotation.agreement_summary(annotation.compared(a, b)).collect()}
    assert summary["all", "samples"] == 4 and summary["all", "present_in_both"] == 2 and ("", "samples") not in summary and ("t", "present_in_both") not in summary and summary["t", "samples"] == 2


def test_unsettled_annotations_are_an_error_unless_allowed(spark):
    agreed = spark.createDataFrame([(1, "t", [(0.0, 0.0, 1.0, 1.0)])], f"sample_id int, task string, boxes array<{BOX}>")
    judged = spark.createDataFrame([(2, "t", []), (3, "t", [(0.0, 0.0, 1.0, 1.0)])], f"sample_id int, task string, adjudicated_boxes array<{BOX}>")
    with pytest.raises(Exception, match="without adjudicated boxes"):
        annotation.final_annotations(agreed, judged).collect()
    got = {r.sample_id: (r.status, len(r.boxes)) for r in annotation.final_annotations(agreed, judged, True).collect()}
    assert got == {1: ("consensus", 1), 2: ("unresolved", 0), 3: ("adjudicated", 1)}
    assert annotation.final_annotations(agreed, judged.where("sample_id = 3")).count() == 2


def test_pairs_need_their_partner_and_cluster(spark):
    left = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "b", None)], "sample_id int, image_id string, v double")
    right = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0), (4, "c", 1.0)], "sample_id int, image_id string, v double")
    run = lambda l, r: {x.image_id: (x.n, x["mean"]) for x in traces.cluster_differences(l, r, "sample_id", "image_id", lambda a, b: a("v") - b("v")).collect()}  # noqa: E731, E741
    assert run(left, right) == {"a": (2, 1.5)}
    with pytest.raises(Exception, match="no partner"):
        run(left, right.where("sample_id <> 2"))
    with pytest.raises(Exception, match="clusters differ"):
        run(left, right.withColumn("image_id", F.lit("z")))


def test_side_values_are_checked(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    side = spark.createDataFrame([(1, 0.25), (2, None)], "k int, risk double")
    inside = lambda c: c.between(0, 1)
    assert [r.risk for r in traces.with_side_values(rows, side, "k", {"risk": 0.5}, {"risk": inside}).orderBy("k").collect()] == [0.25, 0.5, 0.5]
    with pytest.raises(Exception, match="out of range"):
        traces.with_side_values(rows, side.withColumn("risk", F.lit(2.0)), "k", {"risk": 0.5}, {"risk": inside}).collect()


def test_seeds_need_every_sample(spark):
    target = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (3, "b", 1.0)], "id int, image string, v double")
    runs = spark.createDataFrame([(k, s, 1.0) for k in (1, 2, 3) for s in (7, 8)], "id int, seed int, v double")
    got = {(r.seed, r.image): r.difference for r in traces.seed_differences(target, runs, "id", "image", "v").collect()}
    assert got == {(7, "a"): 1.0, (7, "b"): 0.0, (8, "a"): 1.0, (8, "b"): 0.0}
    with pytest.raises(Exception, match="lacks samples"):
        traces.seed_differences(target, runs.where("not (id = 2 and seed = 8)"), "id", "image", "v").collect()


def test_a_stored_coverage_must_be_that_of_the_boxes(spark):
    half = [(0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 1.0, 1.0)]
    t = spark.createDataFrame([(1, half, [0], 0.5), (2, half, [0], 9.0)], f"sample_id int, tokens array<{BOX}>, kept array<int>, ecr double")
    probes = spark.createDataFrame([(1, "positive", [(0.0, 0.0, 1.0, 1.0)]), (2, "negative", [(0.0, 0.0, 1.0, 1.0)])], f"sample_id int, polarity string, regions array<{BOX}>")
    scores = spark.createDataFrame([(1, 0.5, True)], "sample_id int, margin double, correct boolean")
    got = traces.model_rows(t, probes, scores, scores.select("sample_id", "margin")).collect()
    assert [(r.sample_id, r.ecr, r.local_precision, r.kept_tokens) for r in got] == [(1, 0.5, 1.0, 1)]
    with pytest.raises(Exception, match="stored coverage"):
        traces.model_rows(t.withColumn("ecr", F.lit(0.4)), probes, scores, scores.select("sample_id", "margin")).collect()
    with pytest.raises(Exception, match="missing from a table"):
        traces.model_rows(t, probes, scores.where("false"), scores.select("sample_id", "margin")).collect()


def test_checkpoint_keeps_the_common_beginning(spark):
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sample_id string, ord int")
    ids = lambda *n: spark.createDataFrame([(f"s{i}", i * 10) for i in n], "sample_id string, v int")
    got = lambda *p: [[r.sample_id for r in d.collect()] for d in traces.salvaged(samples, *p)]
    assert got(ids(1, 0, 2), ids(0, 1)) == [["s0", "s1"], ["s0", "s1"]]
    assert got(ids(0, 1), ids(1, 0)) == [["s0", "s1"], ["s0", "s1"]]
    assert got(ids(), ids()) == [[], []] and got(ids(0), ids()) == [[], []]
    for rows, kept in ((ids(0, 2), ids(0, 2)), (ids(0, 1, 3), ids(0, 1)), (ids(0, 1), ids(1))):
        with pytest.raises(ValueError, match="finished"):
            traces.salvaged(samples, rows, kept)
    with pytest.raises(ValueError, match="repeated"):
        traces.salvaged(samples, ids(0, 0), ids(0))
    with pytest.raises(ValueError, match="no sample"):
        traces.salvaged(samples, ids(0, 9), ids(0))


def test_controls_need_pairs(spark):
    rows = spark.createDataFrame([("a", 1, "p"), ("a", 2, "p"), ("b", 3, "q"), ("b", 4, "q")], "image_id string, id int, image string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "a")], "image_id string, mapped string")
    paths = spark.createDataFrame([("a", "x"), ("b", "y")], "image_id string, path string")
    got = {r.id: (r.image, r.original_image, r.control_image_id, r.control_seed) for r in traces.controlled(rows, mapping, paths, "blank", None).collect()}
    assert got == {1: ("x", "p", None, None), 2: ("x", "p", None, None), 3: ("y", "q", None, None), 4: ("y", "q", None, None)}
    with pytest.raises(Exception, match="not a pair"):
        traces.controlled(rows.where("id < 4"), mapping, paths, "shuffle", 1).collect()


def test_compare_arms_by_polarity(spark):
    rows = [(i, a, "yes" if i % 2 else "no", float(i + (a == "l"))) for i in range(20) for a in ("l", "r")] + [(99, "l", "yes", 5.0)]
    got = {r.scope: r for r in traces.compare_arms(spark.createDataFrame(rows, "sample_id int, arm string, target_answer string, support double"), "l", "r", n=50).collect()}
    assert {k: (v.n, v["mean"], v.median, v.above, v.low, v.p) for k, v in got.items()} == {"all": (20, 1, 1, 1, 1, 0), "yes": (10, 1, 1, 1, 1, 0), "no": (10, 1, 1, 1, 1, 0)}


def test_decoys_differ_and_prefer_their_kind(spark):
    rows = spark.createDataFrame([(1, "red", "c"), (2, "Red", "c"), (3, "blue", "c"), (4, "7", "n"), (5, None, "n")], "id int, answer string, kind string")
    got = {r.id: r.decoy for r in traces.decoys(rows, "id", "answer", "kind").collect()}
    assert got[1] == got[2] == "blue" and got[3].lower() == "red" and got[4] in ("blue", "Red", "red") and got[5] == "7"
    alone = traces.decoys(rows.where("id < 3"), "id", "answer", "kind").collect()
    assert [r.decoy for r in alone] == [None, None]


def test_every_driver_row_has_another_decoy(spark):
    import os

    from evalweave.plans import catalog

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver tables are not here")
    own = {r.p_partkey: (r.p_name, r.p_type) for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    kinds = {}
    for name, kind in own.values():
        kinds.setdefault(kind, set()).add(name.lower())
    for r in catalog.QUERIES["type_decoys"](spark, sf).collect():
        name, kind = own[r.p_partkey]
        others = kinds[kind] - {name.lower()}
        assert r.decoy and r.decoy.lower() != name.lower() and (not others or r.decoy.lower() in others)


def test_question_and_answer_features(spark):
    rows = spark.createDataFrame([("How many rows between A and B, per 1000?", "12 and 13!", 2), (None, " ", None), ("x", "a a b a b a", 1)], "q string, a string, n int")
    got = rows.select(*[c.alias(k) for k, c in features.answer_features(F.col("q"), F.col("a"), F.col("n")).items()]).collect()
    first = got[0].asDict()
    assert (first["question_len"], first["asks_numeric"], first["question_multi_constraint"], first["low_answer_many_numbers"], first["low_answer_punctuation"], first["numeric_question_digit_missing"]) == (9, 1, 1, 1, 1, 0)
    assert first["question_risk_score"] == 6 and first["target_text_token_count"] == 2
    assert got[1].low_answer_empty == 1 and got[1].question_len == 0 and got[1].target_text_token_count == 0 and got[2].low_answer_repetition == 1


def test_names_of_samples_and_tokens(spark):
    lit, s = F.lit, lambda c: value(spark, c)
    none = F.lit(None).cast("string")
    group = lambda explicit, ident, option, captions: s(features.choice_group(explicit, ident, option, lit("d"), lit("s"), lit("i"), captions))
    no_captions, two = F.array().cast("array<string>"), F.array(lit("a"), lit("b"))
    assert group(lit(" g "), lit("x-1"), lit(1), two) == "g" and group(none, lit("x-1"), lit(1), two) == "x" and group(none, lit("x-2"), lit(1), no_captions) == ""
    digest = group(none, lit("x-2"), lit(1), two)
    assert digest.startswith("choice-") and len(digest) == 23 and digest == group(none, lit("y"), none, two)
    assert s(features.image_number(lit("12"), none)) == 12 and s(features.image_number(none, lit("a/000123.PNG"))) == 123 and s(features.image_number(none, lit("a/12.png"))) is None and s(features.image_number(lit("x"), none)) is None
    assert s(features.token_form(lit(' ("a  b".) '))) == "a b" and s(features.token_form(none)) == ""
    assert s(features.present_tokens(F.array(lit("A."), lit("a"), lit("!"), lit("b")))) == ["a", "b"]
    assert [s(features.mutated_answer(lit(t))) for t in ("a9", "box", "boy", "a!", "")] == ["a0", "boZ", "boX", "a!X", "not shown"]
    assert s(features.alias_variants(lit("dining_table x"))) == ["dining_table x", "dining table x", "dining_tablex"]
    assert [s(features.shape_classes(lit(t))) for t in ("ab", "a1-", "", "é1")] == ["alpha", "alpha+digit+punct", "other", "alpha+digit"]
    assert [s(features.decoy_edit(lit(a), lit(b))) for a, b in (("ab", "ac"), ("ab", "abc"), ("ab", "ba"), ("a", "a"))] == ["single_substitution", "single_deletion_or_insertion", "other", "other"]
    assert s(features.evidence_units(lit(" a | | b"))) == ["a", "b"] and s(features.evidence_units(none)) == []
    assert s(features.complexity(F.array(lit("a")), F.array(lit("multi_constraint_question"), lit("layout_field_question")), none)) == "likely_multi_region" and s(features.complexity(F.array(lit("a")), F.array(lit("x")), none)) == "single_region_likely"


def test_decisions_of_budgets(spark):
    rows = spark.createDataFrame([("A", "a!", "b"), ("a", "b", "B"), ("a", "b", "A"), ("a", "b", "c"), (None, "", "x")], "x string, y string, z string")
    x, y, z = map(F.col, "xyz")
    got = rows.select(traces.pair_decision(x, y, 0.3, 0.7).alias("p"), traces.staged_decision(x, y, z).alias("s"), traces.majority_decision(x, y, z).alias("m")).collect()
    assert [r.p.budget for r in got] == [0.3, 0.7, 0.7, 0.7, 0.3] and [r.s.budget for r in got] == [0.3, 0.7, 1.0, 1.0, 0.3] and [r.m.budget for r in got] == [0.3, 0.5, 0.3, 1.0, 1.0]
    assert got[1].p.cost == pytest.approx(1.5)


def test_lineage_positions_and_tiles(spark):
    ints = lambda *v: F.array(*map(F.lit, v)).cast("array<int>") if v else F.array().cast("array<int>")
    s = lambda c: value(spark, c)
    assert s(geometry.merge_lineage(F.lit(4), ints(3, 1, 1, 9), F.lit(0))) == [1, 3] and s(geometry.merge_lineage(F.lit(4), ints(3), F.lit(2))) == [0, 1, 2, 3] and s(geometry.merge_lineage(F.lit(0), ints(), F.lit(2))) == []
    keep = F.array(F.lit(True), F.lit(False), F.lit(True))
    assert s(geometry.positions(keep, "compact")) == [0, 1] and s(geometry.positions(keep, "preserve")) == [0, 2]
    with pytest.raises(ValueError, match="position mode"):
        geometry.positions(keep, "other")
    made = s(geometry.tiled_boxes(F.lit(3), F.lit(1), F.lit(2), 1, 1))
    assert [tuple(b) for b in made.boxes] == [(0, 0, 0.5, 1), (0.5, 0, 1, 1), (0, 0, 1, 1)] and made.thumbnail
    odd = s(geometry.tiled_boxes(F.lit(4), F.lit(1), F.lit(2), 1, 1))
    assert (odd.rows, odd.columns, odd.thumbnail, len(odd.boxes)) == (1, 4, False, 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "sample_id int, probe string, k int, n int, v double, arm string, target_answer string, support double")
    assert traces.budget_summary(none, "k", "n", []).first()[:] == (0, 0, 0, 0, 0, 0) and traces.probe_cost(none, []).first().samples == 0
    assert traces.compare_arms(none, "a", "b", n=5).count() == 0 and traces.equivalence(none, none, "sample_id", ["v"]).count() == 0
    assert traces.unused(spark.createDataFrame([(None,), (1,)], "k int"), spark.createDataFrame([(None,), (1,)], "k int"), "k").count() == 1


def test_probe_modes(spark):
    kind = "id string, relation string, answer boolean, subject string, object string, subject_bbox array<double>, object_bbox array<double>, question string"
    rows = spark.createDataFrame([("s", "right_of", True, "cup", "box", [0.0], [1.0], None), ("t", "below", False, "a", None, None, None, "is it on the Left?"), ("u", "on", True, "a", "b", None, None, None)], kind)
    table = relations.relation_table(spark)
    run = lambda mode: {(r.id, r.probe): r for r in probes.expand_probes(rows, table, mode=mode).collect()}
    names = lambda got, k: {p for i, p in got if i == k}
    got = run("graph")
    assert names(got, "s") == {"orig", "text_only"} | {f"graph_{v}__{c}" for v in ("img", "text") for c in ("claim__left_of", "anti__right_of")}
    claim = got["s", "graph_img__claim__left_of"]
    assert (claim.subject, claim.question, claim.target, claim.role, claim.probe_count) == ("box", "Is box to the left of cup?", True, "claim", 6)
    assert "graph_img__claim__below" in names(got, "t") and got["u", "graph_text__support__above"].weight == 0.5
    got = run("rec_profile")
    assert names(got, "s") == {"orig", "contra", "text_only", "flip_mapped", "flip_unmapped"} | {f"rec_{v}__{c}" for v in ("img", "text") for c in ("left_of", "right_of")}
    got = run("prompt_sc")
    assert names(got, "s") == {"orig", *[f"prompt_sc_{i}" for i in range(1, 5)]} and got["s", "prompt_sc_1"].question == "According to the image, is cup to the right of box?" and got["t", "orig"].question == "is it on the Left?"
    got = run("orig_text_crop_boxed")
    assert names(got, "s") == {"orig", "text_only", "crop", "boxed"} and names(got, "t") == {"orig", "text_only"} and "object right of the blue-boxed" in got["s", "boxed"].question
    assert names(run("profile_fast"), "u") == {"orig", "contra", "inverse_role", "role_reversal"} - ({"inverse_role", "role_reversal"} if not table.where("relation = 'on'").first().inverse else set())
    with pytest.raises(ValueError, match="no probe mode"):
        run("other")
    assert probes.expand_probes(rows.where("false"), table, mode="graph").count() == 0
