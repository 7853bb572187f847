"""Audits, compact metrics, reuse, run differences, positions of targets, exported boxes, and small helpers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import hashing, maths, ranks, text
from evalweave.functions.boxes import area
from evalweave.operators import audits, evidence, masks, resampling, summaries
from evalweave.sources import annotations, records, tables


def test_visual_audit(spark):
    probes = spark.createDataFrame([(1, "text_only", None), (2, "full", True), (3, "crop", False), (4, None, None), (5, "full", None)], "id int, view string, there boolean")
    assert tuple(summaries.visual_audit(probes, "view", F.col("there")).first()) == (5, 1, 4, 3, 0.75)
    assert [r.id for r in summaries.missing_images(probes, "view", F.col("there"), ["id"], 2).collect()] == [3, 4]
    assert tuple(summaries.visual_audit(probes.limit(0), "view", F.col("there")).first()) == (0, 0, 0, 0, 0.0)


def test_sample_audit_counts_each_tag_once(spark):
    rows = spark.createDataFrame([("a", ["x", "x", "y"]), ("", None), (None, [])], "d string, t array<string>")
    assert {(r.kind, r.value): r.samples for r in summaries.sample_audit(rows, {"d": F.col("d")}, F.col("t")).collect()} == {("d", "a"): 1, ("d", "<empty>"): 2, ("tag", "x"): 1, ("tag", "y"): 1}


def test_main_risks_by_prefix(spark):
    cases = {
        "prompt": ({"prompt_sc_error_auroc": 1.0, "confidence_error_auroc": 2.0}, ["confidence", "prompt_sc"]), "both": ({"prompt_sc_error_auroc": 1.0, "evidence_error_auroc": 2.0}, ["evidence"]),
        "choice": ({"choice_top2_x": 1.0, "evidence_x": 1.0}, ["choice_top2"]), "relation": ({"relation_x": 1.0, "relation_wo_prior_x": 1.0}, ["relation", "relation_wo_prior"]), "rest": ({"visual_lift_x": 1.0, "samples": 3.0}, ["visual_lift"]), "none": ({"samples": 1.0}, []),
    }
    rows = spark.createDataFrame([(k, m) for k, (m, _) in cases.items()], "k string, metrics map<string,double>")
    assert {r.k: r.r for r in rows.select("k", summaries.main_risks(F.col("metrics")).alias("r")).collect()} == {k: want for k, (_, want) in cases.items()}
    given = summaries.compact_metrics(rows, ["k"], risks=["evidence", "confidence"]).collect()
    assert {(r.k, r.place, r.risk, r.metric, r.value) for r in given} == {("both", 1, "evidence", "error_auroc", 2.0), ("prompt", 2, "confidence", "error_auroc", 2.0)}


def test_reused_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "sample_id string, answer string")
    asked = rows.select("sample_id").where("sample_id <> 'c'")
    found = summaries.reused_rows(asked.unionByName(asked), rows, "sample_id", "answer", {"task": "t"}, {"task": "t", "more": 1})
    assert sorted(r.answer for r in found.collect()) == ["x", "y"]
    broken = [({"protocol": {"task": "t"}, "given": {"task": "u"}}, rows, "task"), ({}, rows.unionByName(rows.limit(1)), "repeat"), ({}, rows.where("sample_id = 'a'"), "missing"), ({}, rows.unionByName(spark.createDataFrame([("", "q")], rows.schema)), "without"), ({}, rows.withColumn("answer", F.nullif("answer", F.lit("z"))), "without")]
    for kind, bad, message in broken:
        with pytest.raises(ValueError, match=message):
            summaries.reused_rows(asked, bad, "sample_id", "answer", **kind)
    checked = evidence.reuse_is_valid(spark.createDataFrame([("g", 1.0, 1.0 + 1e-9), ("h", 1.0, 2.0), ("n", None, 1.0)], "g string, a double, b double"), "a", "b", ["g"]).collect()
    assert {r.g: r.valid for r in checked} == {"g": True, "h": False, "n": True}


def test_run_difference_by_cluster(spark):
    left = [("i1:a", "", 1.0, "pos"), ("i1:b", None, 0.0, "pos"), ("i2:a", "k", 5.0, "pos"), ("i3:a", "k", 1.0, "neg"), ("only", "z", 9.0, "pos")]
    right = [("i1:a", 0.0), ("i1:b", 1.0), ("i2:a", 1.0), ("i3:a", 0.0), ("other", 3.0)]
    a, b = spark.createDataFrame(left, "id string, img string, v double, pol string"), spark.createDataFrame(right, "id string, v double")
    r = summaries.run_difference(a, b, "id", "v", "img", ("pol", "pos"), n=50).first()
    assert (r.common, r.clusters, r.difference) == (4, 2, 2.0) and 0.0 <= r.low <= r.high <= 4.0
    assert summaries.run_difference(a, b, "id", "v", "img", n=20).first().difference == np.mean([0.0, 2.5])


def test_target_positions(spark):
    ids, pieces = [5, 1, 2, 3, 1, 2, 9], ["Is", " the", " ST", "OP", "", " sign", "?"]
    cases = {"first candidate": ([[1, 2], [3]], "x", [1, 2, 4, 5]), "second": ([[7], [3, 1]], "x", [3, 4]), "decoded": ([[7]], "STOP", [2, 3]), "case": ([[7], []], "stop sign", [2, 3, 5]), "nothing": ([[7]], "absent", []), "longer": ([[5, 1, 2, 3, 1, 2, 9, 9]], "", []), "overlap": ([[1]], "", [1, 4])}
    rows = spark.createDataFrame([(k, ids, c, pieces, t) for k, (c, t, _) in cases.items()], "k string, ids array<int>, c array<array<int>>, p array<string>, t string")
    got = rows.select("k", text.target_positions(F.col("ids"), F.col("c"), F.col("p"), F.col("t")).alias("at")).collect()
    assert {r.k: r["at"] for r in got} == {k: want for k, (*_, want) in cases.items()}


def test_exported_boxes(spark):
    items = {
        "xywh": ({"x": 10, "y": 5, "w": 20, "h": 10}, {"x": 20.0, "y": 10.0, "w": 40.0, "h": 20.0}), "corners": ({"x1": 30, "y1": 15, "x2": 10, "y2": 5}, {"x": 20.0, "y": 10.0, "w": 40.0, "h": 20.0}), "nested": ({"bounds": {"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2}}, {"x": 20.0, "y": 10.0, "w": 40.0, "h": 20.0}),
        "list": ([10, 5, 20, 10], {"x": 20.0, "y": 10.0, "w": 40.0, "h": 20.0}), "points": ({"polygon": [[10, 5], {"x": 30, "y": 15}, "odd"]}, {"x": 20.0, "y": 10.0, "w": 40.0, "h": 20.0}), "outside": ([190, 5, 200, 10], None), "cut": ([90, 45, 20, 20], {"x": 180.0, "y": 90.0, "w": 20.0, "h": 10.0}),
        "flat": ([1, 1, 0, 5], None), "text": ("box", None), "short": ([1, 2, 3], None), "letters": ({"x": "a", "y": 1, "w": 1, "h": 1}, None),
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in items.items()], "k string, t string").select("k", F.parse_json("t").alias("v"))
    size = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    got = rows.select("k", records.export_box(F.col("v"), size(200, 100), size(100, 50)).alias("b")).collect()
    assert {r.k: r.b.asDict() if r.b else None for r in got} == {k: want for k, (_, want) in items.items()}
    one = rows.where("k = 'list'")
    assert one.select(records.export_box(F.col("v"), size(200, 100), size(0, 0), xywh=False).alias("b")).first().b.asDict() == {"x": 10.0, "y": 5.0, "w": 10.0, "h": 5.0}
    assert one.select(records.export_box(F.col("v"), size(0, 100), size(100, 50)).alias("b")).first().b is None


def test_relabelled_splits(spark):
    one, two = spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([("2", 5)], "id string, extra int")
    got = sorted((r.id, r.split, r.a, r.extra, r.dataset) for r in records.relabelled({"dev": one, "test": two}, "gsr", {"dataset": "D", "a": "fixed"}).collect())
    assert got == [("gsr-dev-1", "dev", "fixed", None, "D"), ("gsr-test-2", "test", "fixed", 5, "D")]


def test_perturbed_boxes(spark):
    rows = spark.range(400).select("id", F.struct(F.lit(0.4).alias("x1"), F.lit(0.4).alias("y1"), F.lit(0.6).alias("x2"), F.lit(0.5).alias("y2")).alias("b"))
    same = rows.select(masks.perturbed(F.col("b"), F.col("id"), 0.0, 0.0).alias("p")).distinct().collect()
    assert len(same) == 1 and all(abs(a - b) < 1e-12 for a, b in zip(same[0].p, (0.4, 0.4, 0.6, 0.5), strict=True))
    moved = rows.select("id", masks.perturbed(F.col("b"), F.col("id"), 0.2, 0.1, seed=3, drop=0.25).alias("p"))
    kept = [r.p for r in moved.collect() if r.p]
    assert 60 < 400 - len(kept) < 140 and moved.collect() == moved.repartition(3).orderBy("id").collect()
    assert all(0.18 <= p.x2 - p.x1 <= 0.22 and abs((p.x1 + p.x2) / 2 - 0.5) <= 0.04 + 1e-12 for p in kept)
    assert rows.select(masks.perturbed(F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("x2"), F.lit(1.0).alias("y2")), F.col("id"), 0.1, 0.1).alias("p")).where("p is not null").count() == 0
    assert rows.select(area(F.col("b")).alias("a")).first().a > 0


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3)], "g string, h string, v int")
    assert sorted(map(tuple, audits.crosstab(rows, "g", "h").collect())) == [("a", "x", 2), ("b", "y", 1)]
    assert sorted(r.v for r in rows.withColumn("first", ranks.first_n([F.col("v").desc()], ["g"], 1)).where("first").collect()) == [2, 3]
    assert [r[0] for r in spark.createDataFrame([("im:1:x",), ("plain",), ("",)], "i string").select(hashing.group_prefix(F.col("i"))).collect()] == ["im", "plain", ""]
    grid = spark.createDataFrame([(1,), (12,), (13,), (36,)], "n int").select(maths.closest_factor_grid(F.col("n")).alias("g")).collect()
    assert [(r.g.rows, r.g.columns) for r in grid] == [(1, 1), (3, 4), (1, 13), (6, 6)]
    draws = spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", 0.0)], "g string, v double")
    assert {r.g: r.p for r in resampling.bootstrap_p(draws, "v", ["g"]).collect()} == {"a": 0.5, "b": 0.0, "c": 1.0}
    probes = spark.createDataFrame([("s", "orig", 9), ("s", "crop", 9), ("s", "other", 9), ("t", "orig", 9)], "sample_id string, probe string, probe_count int")
    assert sorted((r.probe, r.probe_count) for r in evidence.require_probes(probes, ["orig", "crop"]).collect()) == [("crop", 2), ("orig", 2)]
    b = F.struct(F.lit(0.105).alias("x1"), F.lit(-0.2).alias("y1"), F.lit(0.108).alias("x2"), F.lit(2.0).alias("y2"))
    assert tuple(spark.range(1).select(masks.pixel_box(b, F.lit(100), F.lit(50)).alias("p")).first().p) == (10, 0, 11, 50)
    images, categories = spark.createDataFrame([(1, "f.jpg", 100.0, 50.0)], "id int, file_name string, width double, height double"), spark.createDataFrame([(7, "cat")], "id int, name string")
    marks = spark.createDataFrame([(1, 7, [10.0, 5.0, 30.0, 20.0], 600.0, 0), (1, 7, [0.0, 0.0, 9.0, 9.0], 5.0, 0), (1, 7, [0.0, 0.0, 50.0, 50.0], 900.0, 1)], "image_id int, category_id int, bbox array<double>, area double, iscrowd int")
    found = annotations.instance_index(images, categories, marks, 10.0).collect()
    assert len(found) == 1 and found[0].category == "cat" and np.allclose(found[0].box, (0.1, 0.1, 0.4, 0.5))
    tables.write_report(spark.createDataFrame([(2, [1.5])], "b int, a array<double>"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0]) == {"a": [1.5], "b": 2}
    with pytest.raises(ValueError):
        tables.write_report(rows, str(tmp_path / "other"))
