import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.llm.language_id import fit, identify, predict
from evalweave.llm.licenses import CONFIRM, CUE, TEMPLATES, bigrams_of, cue_is_safe, scan_licenses, template_list, trained, words_of
from evalweave.llm.mixing import mix_sources, rates
from evalweave.llm.shards import ShardedTable, shard_documents
from evalweave.llm.url_lists import apply_lists, host_of, intervals, list_events, page_events

from .fixtures import DOC, awkward, empty, prose


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def licences(spark, texts):
    return {r.doc_id: (r.licenses, r.n_confirmed) for r in scan_licenses(documents(spark, texts)).collect()}


def test_licence_families(spark):
    texts = ["Text.\nReleased under the MIT License.\nMore.", "ALL RIGHTS RESERVED.", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "He lost his driving licence.", None, "", "the copyright law of 1911 was long", "This work is licensed under the GNU General Public License, version 3. " + prose(4, 3000)]
    got = licences(spark, texts)
    assert [got[i][0] for i in range(8)] == ["mit", "proprietary", "apache,cc-by-nc", "", "", "", "", "gpl"]


SHORT = {
    "agpl": "AGPL-3.0-or-later", "apache": "Apache-2.0", "bsd": "BSD-3-Clause", "cc-by": "CC-BY-4.0", "cc-by-nc": "CC-BY-NC-4.0", "cc-by-nd": "CC-BY-ND-4.0", "cc-by-sa": "CC-BY-SA-4.0",
    "cc0": "CC0-1.0", "gpl": "GPL-3.0", "lgpl": "LGPL-2.1", "mit": "MIT", "mpl": "MPL-2.0",
}
FULL = {"cc-by": "Attribution", "cc-by-sa": "Attribution-ShareAlike", "cc-by-nd": "Attribution-NoDerivatives", "cc-by-nc": "Attribution-NonCommercial-ShareAlike"}


def test_full_and_short_notices_of_each_family(spark):
    notices = [(f, form.format(x)) for f, x in SHORT.items() for form in ("SPDX-License-Identifier: {}", "License: {}", "Licensed under {}.")]
    notices += [(f, f"This work is licensed under a Creative Commons {x} {v} License.") for f, x in FULL.items() for v in ("4.0 International", "3.0 Unported")]
    notices += [("gpl", "License: GPLv3"), ("", "SPDX-License-Identifier: Zlib"), ("", "License: ISC"), ("", "MIT gave a license to the startup"), ("cc-by-sa", "CC-BY-SA-4.0")]
    got = licences(spark, [text for _, text in notices])
    assert [(text, got[i][0]) for i, (_, text) in enumerate(notices)] == [(text, f) for f, text in notices]


def test_licences_that_are_not_granted(spark):
    none = ["Licensed under the Eclipse Public License version 2.0.", "He said the apache license plate was released under the mit roof.", "All of this work is not licensed under the GNU General Public License version 3.", "They have all rights reserved seats.",
            "Released under the ISC License.", "Licensed under the zlib license", "The software is not released under the MIT License.", "This work is not dedicated to the public domain."]
    wrapped = [("apache", "Unless required by law or agreed to in writing,\nsoftware distributed under the License is distributed on\nan AS IS BASIS, WITHOUT WARRANTIES OR\nCONDITIONS OF ANY KIND."),
               ("cc-by-sa", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."), ("", "Released under the\n\nMIT License"), ("mit", "x\nReleased under the\n MIT License")]
    got = licences(spark, [*none, *[t for _, t in wrapped], "SPDX-License-Identifier: MIT"])
    assert [(t, got[i][0]) for i, t in enumerate(none)] == [(t, "") for t in none]
    assert [(t, got[i][0]) for i, (_, t) in enumerate(wrapped, len(none))] == [(t, f) for f, t in wrapped]
    assert got[len(none) + len(wrapped)][0] == "mit"


def test_no_template_can_be_confirmed_without_a_cue():
    assert cue_is_safe() and 0.5 <= trained()["least"] < 1


def test_licence_rows(spark):
    docs = documents(spark, ["All rights reserved."] * 2)
    docs = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(((r.doc_id is None, r.doc_id, r.licenses) for r in scan_licenses(docs.withColumn("p", F.lit(1))).collect()), key=str) == [(False, 0, "proprietary"), (False, 1, "proprietary"), (True, None, "proprietary")]
    assert scan_licenses(empty(spark)).count() == 0


def test_every_template_has_a_cue_and_is_its_own_family():
    import re

    model = trained()
    for family, sentence in template_list():
        assert re.search(CUE, sentence), sentence
        words = words_of(sentence)
        grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        z = np.array(model["bias"]) + sum(np.array(model["weights"][g]) for g in grams)
        assert model["families"][int(z.argmax())] == family, sentence
        assert len(bigrams_of(words)) * CONFIRM > 0
    assert set(model["families"][1:]) == set(TEMPLATES)


LANGS = {"aa": "kalo mira tesu rano".split(), "bb": "wexi quop jubz vynk".split(), "cc": "šumé žilo řeka čas".split()}


def spoken(spark, n=400):
    rng, rows = random.Random(0), []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        words = ["".join(rng.choices(LANGS[lang], k=rng.randrange(1, 3))) for _ in range(rng.randrange(3, 40))]
        rows.append((i, " ".join(words), lang, "s", 0))
    return spark.createDataFrame(rows, DOC)


def test_language_held_out_accuracy(spark):
    docs = spoken(spark)
    got = identify(docs.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(2))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 120 and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def twin(rows):
    """A plain scorer on dicts of counts: lang_pred and score of every text."""
    import math
    import unicodedata
    import zlib

    def words(text):
        out, word = [], ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] in "LM":
                word += c
            else:
                out, word = out + [word] * any(unicodedata.category(x)[0] == "L" for x in word), ""
        return out

    def spans(word, n):
        return [word] if not n else [("^" * (i == n) + word[i - n : i] + "$" * (i == len(word)), i) for i in range(n, len(word) + 1)]

    seen = {n: {} for n in range(6)}
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang is not None and text is not None:
            for w in words(text):
                for n in range(6):
                    for g in [w] if not n else [g for g, _ in spans(w, n)]:
                        seen[n].setdefault(g, Counter())[lang] += 1
    langs = sorted({c for n in seen for g in seen[n].values() for c in g})
    total = {(n, c): sum(g[c] for g in seen[n].values()) for n in seen for c in langs}
    log = lambda n, g, c: math.log((seen[n][g][c] + 0.5) / (total[n, c] + 0.5 * len(seen[n])))
    out = []
    for _, text, _ in rows:
        own, sums = words(text), dict.fromkeys(langs, 0.0)
        for w in own:
            at = {}
            for n in range(5, 0, -1) if w not in seen[0] else ():
                for g, i in spans(w, n):
                    if i not in at and g in seen[n]:
                        at[i] = (n, g)
            for c in langs:
                sums[c] += log(0, w, c) if w in seen[0] else sum(log(n, g, c) for n, g in at.values()) / len(w)
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        odds = {c: sums[c] / len(own) * min(len(own), 20) for c in langs}
        best = max(langs, key=lambda c: odds[c])
        out.append((best, 1 / sum(math.exp(odds[c] - odds[best]) for c in langs)))
    return out


def test_language_equals_a_plain_scorer(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spoken(spark, 200).collect()] + [(r.doc_id, r.text, r.lang) for r in awkward(spark).where("doc_id is null or doc_id not in (9, 10)").collect()]
    rows += [(900 + i, t, None) for i, t in enumerate(["kalowexx vynkřek", "Šumé\u0301 12 ŽILO", "İstanbul straße", "q", "́ ", "kalo" * 30])]
    docs = spark.createDataFrame([(i, t, c, "s", 0) for i, t, c in rows], DOC)
    got = {(r.doc_id, r.n): (r.lang_pred, r.score) for r in predict(docs.withColumn("n", F.length("text")), fit(docs)).collect()}
    for (i, text, _), (lang, score) in zip(rows, twin(rows), strict=True):
        assert got[i, None if text is None else len(text)][0] == lang and abs(got[i, None if text is None else len(text)][1] - score) < 1e-9, text


def test_language_many_languages_and_clashing_names(spark):
    own = ["".join(chr(97 + i // 26**d % 26) for d in range(3)) for i in range(600)]
    rows = [(i * 20 + k, f"{own[i]}wo {own[i]}rt {k}", f"l{i:03d}", "s", 0) for i in range(600) for k in range(6)]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("_text", "text_", "share", "n", "place"):
        docs = docs.withColumn(name, F.lit(1))
    got = predict(docs, fit(docs, total_docs=1200)).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.9 and len({r.lang_pred for r in got}) > 580


def test_language_awkward(spark):
    model = fit(spoken(spark))
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "123 !!"), (3, "́"), (4, "KALO"), (5, "kalomirawexx"), (6, "x" * 50_000), (7, "wexi " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in predict(rows, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 4 + ["aa", "aa"] and got[2].score == 0 and got[7].lang_pred == "bb" and got[6].lang_pred in LANGS
    none = identify(awkward(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and identify(empty(spark)).count() == 0


def test_language_does_not_look_at_labels(spark):
    docs, model = spoken(spark), fit(spoken(spark))
    a = predict(docs, model).select("doc_id", "lang_pred").collect()
    b = predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def test_mixing_rates_and_counts(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "small", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOC)
    out = mix_sources(docs, weights={"big": 1.0, "small": 1.0}, epochs=2.0).collect()
    count = Counter(r.source for r in out)
    assert abs(count["big"] - 4000) < 300 and abs(count["small"] - 4000) < 300
    per_doc = Counter(r.doc_id for r in out if r.source == "small")
    mean = sum(per_doc.values()) / 400
    assert abs(np.var([per_doc.get(i * 10, 0) for i in range(400)]) / mean - 1) < 0.3
    again = mix_sources(docs.repartition(7), weights={"big": 1.0, "small": 1.0}, epochs=2.0).collect()
    assert sorted((r.doc_id, r.copy) for r in out) == sorted((r.doc_id, r.copy) for r in again)
    assert all(sorted(r.copy for r in out if r.doc_id == i) == list(range(per_doc.get(i, 0))) for i in (0, 10, 20))


def test_mixing_without_ids_and_with_clashing_names(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "en", "s", 0) for i in range(400)], DOC)
    for name in ("full", "rest_cdf", "full_cdf", "rate", "n", "_source", "_row", "_key", "a b.c"):
        docs = docs.withColumn(name, F.lit(name))
    out = mix_sources(docs, epochs=2.0).collect()
    count = Counter(r.text for r in out)
    assert abs(len(out) - 800) < 120 and len(set(count.values())) > 3 and out[0]["full"] == "full" and out[0]["a b.c"] == "a b.c"
    same = spark.createDataFrame([(1, f"text {i}", "en", "s", 0) for i in range(400)], DOC)
    assert abs(mix_sources(same, epochs=2.0).count() - 800) < 120


def test_mixing_awkward(spark):
    got = mix_sources(awkward(spark), epochs=30.0)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"] and got.where("source is null").count() > 0 and got.where("doc_id is null").count() > 0
    assert mix_sources(empty(spark)).count() == 0 and mix_sources(awkward(spark), weights={"a": 1.0}).where("source is distinct from 'a'").count() == 0
    rate = {r._source: r.rate for r in rates(awkward(spark), epochs=30.0).collect()}
    assert abs(sum(rate[r["source"]] for r in awkward(spark).collect()) - 30 * 15) < 1e-6
    with pytest.raises(ValueError):
        rates(awkward(spark), weights={"a": -1.0})


def test_sharding_keeps_every_row(spark, tmp_path):
    docs = awkward(spark).unionByName(awkward(spark))
    out = shard_documents(docs, f"file://{tmp_path}/t", arrivals=5)
    assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_sharding_versions_and_tiers(spark, tmp_path):
    t = ShardedTable(spark, f"file://{tmp_path}/t", target=1 << 20, fanout=3, floor=1 << 10)
    for k in range(7):
        t.append(spark.range(k * 100, k * 100 + 100).coalesce(1))
    assert t.version() == 7 and t.read(3).count() == 300
    before = len(t.manifest()["shards"])
    last = t.compact()
    assert last > 7 and len(t.manifest()["shards"]) < before and t.read().count() == 700 and t.read(7).count() == 700
    assert not t.runs(t.manifest()["shards"])
    t.append(spark.range(0))
    assert t.read().count() == 700
    assert t.vacuum(t.version()) > 0 and t.read().count() == 700
    with pytest.raises(ValueError):
        t.append(spark.range(3).withColumnRenamed("id", "other"))


def test_sharding_commits_once(spark, tmp_path):
    t = ShardedTable(spark, f"file://{tmp_path}/t")
    t.append(spark.range(5))
    slow = t.manifest()
    t.append(spark.range(5))  # another writer was faster
    with pytest.raises(RuntimeError):
        t.commit(slow, slow["schema"], [])
    assert t.version() == 2 and t.read().count() == 10 and t.read(1).count() == 5
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith(".manifest") and not p.name.endswith(".crc")]


def test_sharding_many_versions(spark, tmp_path):
    """Manifests hold differences; a plain model of tiers says what is merged."""
    t = ShardedTable(spark, f"file://{tmp_path}/t", fanout=3, floor=1)
    model = []
    for k in range(20):
        t.append(spark.range(k, k + 1).coalesce(1))
        model.append(t.manifest()["shards"][-1]["bytes"])
        assert sorted(s["bytes"] for s in t.manifest()["shards"]) == sorted(model) and t.manifest(k + 1)["version"] == k + 1
        if k % 5 == 4:
            tiers = Counter(t.tier(b) for b in model)
            merged = [b for b in model if tiers[t.tier(b)] >= 3]
            before = t.version()
            assert t.compact() >= before + bool(merged) and not t.runs(t.manifest()["shards"])
            break
    assert sorted(r.id for r in t.read().collect()) == list(range(5)) and t.read(3).count() == 3


def test_sharding_awkward_tables(spark, tmp_path):
    out = shard_documents(empty(spark), f"file://{tmp_path}/a")
    assert out.columns == [*empty(spark).columns, "shard", "shard_bytes", "version"] and out.count() == 0
    docs = awkward(spark)
    for name in ("_arrival", "arrival", "shard", "version", "a b"):
        docs = docs.withColumn(name, F.lit("x"))
    out = shard_documents(docs, f"file://{tmp_path}/b")
    assert sorted(out.columns) == sorted([*docs.columns, "shard_bytes"]) and out.where("_arrival = 'x' and arrival = 'x' and `a b` = 'x' and shard <> 'x'").count() == docs.count()


def test_events_of_pages(spark):
    pages = spark.createDataFrame([(i, f"http://{'www.' * (i % 2)}h{i % 40}.example.com/{'abc'[i % 3]}/x") for i in range(300)] + [(300, None), (301, "none")], "page_id long, url string")
    rows = page_events(pages).collect()
    assert {r.action for r in rows} == {"add", "remove"} and len({r.list for r in rows}) == 5 and any("/" in r.key for r in rows)
    assert sorted(rows) == sorted(page_events(pages.repartition(7).unionByName(pages)).collect()) and page_events(pages.limit(0)).count() == 0
    often = Counter((r.list, r.key) for r in rows)
    assert max(often.values()) == 3 and intervals(page_events(pages)).count() > len(often)


EVENTS = [("l", "bad.com", "2024-01-10", "add"), ("l", "bad.com", "2024-02-01", "remove"), ("l", "bad.com", "2024-03-01", "add"), ("m", "ok.org/x/y", "2024-01-01", "add"), ("m", "ok.org/x/y", "2024-01-01", "add"), ("n", "same.day", "2024-01-05", "add"), ("n", "same.day", "2024-01-05", "remove")]


def active(url, day):
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url or "")
    if not m or not day:
        return []
    host, path = m[1].lower().rstrip("."), "/" + "/".join(s for s in m[2].split("/") if s)
    out = set()
    for name in "lmn":
        for key in {k for n, k, _, _ in EVENTS if n == name}:
            own, _, prefix = key.partition("/")
            if (host == own or host.endswith("." + own)) and (not prefix or (path + "/").startswith(f"/{prefix}/")):
                past = [(d, a == "remove") for n, k, d, a in EVENTS if (n, k) == (name, key) and d <= day]
                if past and not max(past)[1]:
                    out.add(name)
    return sorted(out)


def test_urls_against_brute_force(spark):
    urls = ["http://bad.com/a", "https://www.BAD.com:8080/", "http://notbad.com/", "http://user@bad.com./q?x#y", "http://ok.org/x/y", "http://ok.org/x//y/z?k", "http://ok.org/x/yy", "http://a.b.ok.org/x/y/", "http://same.day/", "no url", "", None, "ftp://bad.com"]
    days = ["2024-01-01", "2024-01-10", "2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", None]
    rows = [(i, u, d) for i, (u, d) in enumerate((u, d) for u in urls for d in days)]
    pages = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("fetch_day", F.col("d").cast("date")).withColumn("lists", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r.page_id: r for r in apply_lists(pages.unionByName(pages), list_events(spark, EVENTS)).collect()}
    assert {i: (got[i].lists.split(",") if got[i].lists else [], got[i].keep) for i in got} == {i: (active(u, d), not active(u, d)) for i, u, d in rows}
    assert apply_lists(pages.limit(0), list_events(spark, EVENTS)).count() == 0 and apply_lists(pages, list_events(spark, EVENTS).limit(0)).where("keep").count() == len(rows)
    assert intervals(list_events(spark, EVENTS)).count() == 3
    assert spark.createDataFrame([("HTTP://A.b:1/x",)], "u string").select(host_of(F.col("u"))).first()[0] == "a.b"
