"""Records and reports of unknown shape, masks over budgets, dominators and constrained permutations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalweave.functions import boxes
from evalweave.operators import assignments, masks
from evalweave.sources import records


def parsed(spark, objects):
    return spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "ord int, t string").select("ord", F.parse_json("t").alias("record"))


def regions(row):
    return [tuple(round(b[c], 6) for c in ("x1", "y1", "x2", "y2")) for b in row.evidence_regions]


@pytest.mark.parametrize("field", records.REGION_FIELDS)
def test_every_field_and_layout(spark, field):
    layouts = [
        [10, 5, 40, 25], {"bbox": [10, 5, 40, 25]}, {"box": {"x1": 10, "y1": 5, "x2": 40, "y2": 25}}, {"region": {"x": 10, "y": 5, "w": 30, "h": 20}}, {"rect": {"x": 10, "y": 5, "width": 30, "height": 20}}, {"bounds": "10, 5, 40, 25"},
        {"points": [[10, 5], [40, 5], [40, 25]]}, {"polygon": [{"x": 10, "y": 25}, {"X": 40, "Y": 5}, "odd"]}, {"vertices": [[40, 25], [10, 5]]}, "10,5,40,25", {"x1": 10, "y1": 5, "x2": 40, "y2": 25}, [40, 25, 10, 5],
    ]
    rows = [{field: [box], "width": 100, "height": 50} for box in layouts] + [{field: {"b": [0.1, 0.1, 0.4, 0.5], "a": {"bbox": [0, 0, 1, 1]}}}, {field: [[0.1, 0.1, 0.4, 0.5], [0.1, 0.1, 0.4, 0.5000000001], None, "none", [5, 5], {"text": "x"}]}]
    got = sorted(records.region_samples(parsed(spark, rows)).collect(), key=lambda r: int(r.id.rsplit("-", 1)[1]))
    assert [regions(r) for r in got[: len(layouts)]] == [[(0.1, 0.1, 0.4, 0.5)]] * len(layouts)
    assert sorted(regions(got[-2])) == [(0.0, 0.0, 1.0, 1.0), (0.1, 0.1, 0.4, 0.5)] and regions(got[-1]) == [(0.1, 0.1, 0.4, 0.5)]


def test_first_filled_field_sizes_and_texts(spark):
    rows = [
        {"id": 7, "evidence_regions": [], "ocr_tokens": [[0, 0, 1, 1]], "ocr_boxes": [[0, 0, 0.5, 1]], "question": " a ", "answers": ["x", "y"], "image": "p.jpg", "image_id": 3},
        {"sample_id": "s", "answer_bboxes": "text", "ocr_tokens": [[0, 0, 1, 1]], "prompt": "p", "label": 4, "file_name": "/abs.jpg", "dataset": ""},
        {"ocr_regions": [[10, 10, 20, 20]], "query": None, "answer": []}, {"ocr_regions": [[10, 10, 20, 20]], "image_size": [100, "50"], "dataset": "own", "question": None, "query": "later"}, {"ocr_bboxes": [[10, 10, 20, 20]], "width": 0, "height": 5}, {},
    ]
    got = records.region_samples(parsed(spark, rows), image_root="/root/").orderBy("evidence_region_count", "id").collect()
    at = {r.id: r for r in got}
    assert regions(at["7"]) == [(0.0, 0.0, 0.5, 1.0)] and (at["7"].question, at["7"].answer, at["7"].image, at["7"].image_id, at["7"].bbox_source) == ("a", "x", "/root/p.jpg", "3", "ocr_regions")
    assert (at["s"].evidence_region_count, at["s"].bbox_source, at["s"].question, at["s"].answer, at["s"].image, at["s"].dataset) == (0, "none", "p", "4", "/abs.jpg", "OCR-Regions")
    assert at["ocr-region-2"].evidence_region_count == 0 and at["ocr-region-2"].answer == "" and regions(at["ocr-region-3"]) == [(0.1, 0.2, 0.2, 0.4)] and at["ocr-region-3"].dataset == "own" and at["ocr-region-3"].width == 100.0
    assert at["ocr-region-4"].evidence_region_count == 0 and at["ocr-region-5"].answer == ""


def test_files(spark, tmp_path):
    rows = [{"id": "a", "ocr_boxes": [[0, 0, 1, 1]]}, {"id": "b"}]
    (tmp_path / "x.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, rows)) + "\n")
    for name, content in (("list", rows), ("data", {"data": rows}), ("samples", {"samples": rows, "note": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=1))
    for name in ("x.jsonl", "list.json", "data.json", "samples.json"):
        got = records.region_samples(records.read_records(spark, str(tmp_path / name))).collect()
        assert sorted((r.id, r.evidence_region_count) for r in got) == [("a", 1), ("b", 0)]
    (tmp_path / "odd.json").write_text('{"rows": []}')
    with pytest.raises(Exception, match="neither"):
        records.read_records(spark, str(tmp_path / "odd.json")).collect()


def test_captions(spark):
    rows = [
        {"caption": "The cat is left of the dog.", "label": 1, "image": "c.jpg", "reference_frame": "viewer"}, {"sentence": "A cup is on top of a table", "answer": "No", "image_link": "http://x"}, {"text": "nothing here", "label": True},
        {"caption": "The cup next to a plate", "relation": "right of", "label": "y"}, {"caption": "A dog chases the cat", "relation": "chases", "label": 0}, {"caption": "the cat is to the right of the dog", "label": 0.5},
    ]
    every = {r.id[-1]: r for r in records.caption_samples(parsed(spark, rows), "Some/Set", "dev", left_right_only=False).collect()}
    assert {k: (r.relation, r.subject, r.object, r.answer) for k, r in every.items()} == {
        "0": ("left_of", "cat", "dog", "yes"), "1": ("above", "cup", "table", "no"), "3": ("right_of", "", "", "yes"), "4": ("chases", "dog", "cat", "no"), "5": ("right_of", "cat", "dog", "yes")
    }
    assert every["0"].id == "vsr-some-set-dev-0" and every["0"].question == "Is this statement true? The cat is left of the dog." and every["0"].reference_frame == "viewer" and every["1"].binary_polarity == "negative"
    assert {r.id[-1] for r in records.caption_samples(parsed(spark, rows), "s", "dev").collect()} == {"0", "3", "5"}
    assert {r.id[-1] for r in records.caption_samples(parsed(spark, rows), "s", "dev", False, families=["vertical"]).collect()} == {"1"}
    assert {r.id[-1] for r in records.caption_samples(parsed(spark, rows), "s", "dev", False, relations=["chases"]).collect()} == {"4"}


def test_reports(spark):
    report = {"a": {"b": [1, 2.5, {"c": None}], "d": "x", "none": {}}, "e": True, "f": []}
    flat = spark.createDataFrame([(1, json.dumps(report)), (2, "3"), (3, None)], "k int, t string").select("k", F.parse_json("t").alias("report"))
    got = {(r.k, r.path): r.value for r in records.flattened(flat, ["k"]).collect()}
    assert got == {(1, "a.b[0]"): "1", (1, "a.b[1]"): "2.5", (1, "a.b[2].c"): None, (1, "a.d"): "x", (1, "e"): "true", (2, ""): "3"}
    with pytest.raises(ValueError):
        records.flattened(flat, ["k"], deepest=2)
    nested = {"risks": {"r": {"auc": {"estimate": 0.5, "ci_low": 0.1}, "acc": {"estimate": 1}}, "s": {}}, "categories": {"bad": [{"id": "x"}, {"id": "y"}]}}
    one = spark.createDataFrame([(json.dumps(nested),)], "t string").select(F.parse_json("t").alias("report"))
    ci = records.report_rows(one, [], "$.risks", ["risk", "metric"], {"estimate": "double", "ci_low": "double"}).collect()
    assert sorted(map(tuple, ci), key=str) == [("r", "acc", 1.0, None), ("r", "auc", 0.5, 0.1)]
    assert sorted(map(tuple, records.report_rows(one, [], "$.categories", ["category", "rank"], {"id": "string"}).collect())) == [("bad", "1", "x"), ("bad", "2", "y")]
    assert records.report_rows(one, [], "$.missing", ["a"], {}).count() == 0


def test_masks_over_budgets(spark):
    rows = [("s", 0.3, i) for i in (0, 5, 64, 129)] + [("s", 0.5, i) for i in (0, 5, 64, 70, 199)] + [("s", 0.7, i) for i in range(0, 200, 2)] + [("t", 0.7, 1), ("t", 0.7, 1)]
    out = {r.s: r for r in masks.cross_budget_features(spark.createDataFrame(rows, "s string, b double, i int"), "s", "b", "i", F.lit(200), [0.3, 0.5, 0.7]).collect()}
    a, b, c = ({i for s, x, i in rows if s == "s" and x == r} for r in (0.3, 0.5, 0.7))
    assert (out["s"].jaccard_low_mid, out["s"].jaccard_low_high) == (len(a & b) / len(a | b), len(a & c) / len(a | c)) and out["s"].new_low_mid == len(b - a) / len(b) and out["s"].new_mid_high == len(c - b) / len(c)
    assert abs(out["s"].entropy_gain_mid_high - (1.0 - (out["s"].entropy_gain_low_mid + 0.4515449934959717))) < 1e-6 and out["t"].jaccard_low_mid == 0.0 and out["t"].new_mid_high == 1.0


def test_dominators_against_pairs(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(2), rng.randrange(9), rng.randrange(9)) for i in range(150)]
    got = {r.i: (r.front, r.dominators) for r in assignments.beaten_by(spark.createDataFrame(data, "i int, g int, c int, q int"), ["g"], "i", "c", "q").collect()}
    beats = lambda x, y: x[1] == y[1] and x[2] <= y[2] and x[3] >= y[3] and (x[2] < y[2] or x[3] > y[3])
    front = [x for x in data if not any(beats(y, x) for y in data)]
    for x in data:
        want = [y[0] for y in sorted((y for y in front if beats(y, x)), key=lambda y: (y[3], y[2], y[0]))][:4]
        assert got[x[0]] == (x in front, want)


NORMAL = {"trim": lambda s: s.strip(), "fold": lambda s: "".join(c for c in __import__("unicodedata").normalize("NFKD", s) if c.isalnum()).lower()}


def tokens(spark, of):
    return spark.createDataFrame([(k, f"{n}:{f(t)}") for k, ts in of.items() for t in ts for n, f in NORMAL.items()], "key string, token string")


def test_derangement_without_collisions(spark):
    """Facts: a permutation without fixed points or shared tokens; texts that are equal after folding collide."""
    forbidden = tokens(spark, {"a": ["CONTROL", "CONTROl"], "b": ["PRICE", "PR1CE"], "c": ["TOTAL", "T0TAL"], "d": ["DATE", "D4TE"]})
    observed = tokens(spark, {"a": ["CONTROL", "OTHER"], "b": ["PRICE", "VALUE"], "c": ["TOTAL", "AMOUNT"], "d": ["DATE", "NUMBER", "TOTAL"]})
    for seed in range(3):
        got = dict(assignments.collision_free_derangement(forbidden, observed, seed).collect())
        assert set(got) == set(got.values()) == set("abcd") and all(s != t for s, t in got.items()) and got["c"] != "d"
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        assignments.collision_free_derangement(tokens(spark, {"a": ["Café"], "b": ["TOTAL"]}), tokens(spark, {"a": ["Café"], "b": ["CAFE"]}), rounds=3)


def test_dense_conflicts_settle(spark):
    rng = random.Random(1)
    words = {f"k{i}": [f"w{rng.randrange(40)}" for _ in range(3)] for i in range(120)}
    forbidden = spark.createDataFrame([(k, w) for k, ws in words.items() for w in ws] + [("alone", None)], "key string, token string")
    observed = spark.createDataFrame([(k, w) for k, ws in words.items() for w in ws] + [("alone", "none")], "key string, token string")
    got = dict(assignments.collision_free_derangement(forbidden, observed).collect())
    assert set(got) == set(got.values()) == {*words, "alone"}
    assert all(s != t and not set(words.get(s, [])) & set(words.get(t, [])) for s, t in got.items())
    none = assignments.collision_free_derangement(forbidden.where("false"), observed)
    assert none.count() == 0


def test_boxes_are_computed_once(spark):
    """Inside of a lambda nothing is shared: an expression that is named twice is computed twice, for each item and each of its regions."""
    once = lambda c: str(c).count("needle") == 1
    assert once(boxes.distinct_boxes(F.col("needle")))
    scaled = str(boxes.normalised(boxes.box(*[F.col(c) for c in "abcd"]), F.col("needle"), F.lit(1)))
    assert scaled.count("needle") == 2  # once a corner
    assert str(records.region_box(F.col("item"))).count("struct<bbox variant") == 1
