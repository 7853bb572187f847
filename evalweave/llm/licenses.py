"""Licence scans: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Paragraphs are the lines of a text and, for notices that are wrapped, up to :data:`WRAP` lines on end that no blank line parts, all but the last of at most :data:`WRAP_CHARS` characters. They are cut into words ``[a-z0-9.]+`` and their distinct 1- to 3-grams.
A logistic regression gives each licence family a score; "unknown" is one of its classes,
trained on paragraphs that talk about licences without granting one, on denied grants and on names of other licences. A family needs a posterior of at least ``least``, the calibrated threshold: the smallest at which
none of the texts in :data:`UNSEEN` and of the held-out variants, with which it isn't trained, is taken for a family that it isn't. A predicted family counts when the paragraph has at least ``CONFIRM`` of the weight of one of its templates'
2-grams; those that only one family uses weigh double, and those with a cue (a part of "licence", "copyright", ...) as much as it takes that no paragraph is confirmed without them.

Paragraphs without a cue word are left out, which loses no positive: in every template the 2-grams without a cue word hold less than ``CONFIRM`` of its weight (:func:`cue_is_safe`, a test), so that such a paragraph can't be confirmed.

The model is small and fixed by the templates (some thousand n-grams), trained on the driver; its weights are whole numbers, so that sums don't depend on their order. Scanning is DataFrame
operations only: distinct paragraphs are scored once, however often they repeat, and join back.

Cases: null and empty texts have no licence; a null doc_id is a document like others; rows that repeat a doc_id are one document with the paragraphs of all of them; equal scores
go to the family that sorts first; several families are listed in order; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import written

#: Parts of words, and a word; a paragraph without any of them is no notice.
CUES = ["licen", "copyright", "reserved", "domain", "commons", "permission", "redistribut", "warrant", "cc0", "spdx"]
CUE_WORD = "cc"
CUE_WORD_AT = "(^|[^a-z0-9.])cc([^a-z0-9]|$)"
CUE = "|".join([*CUES, CUE_WORD_AT])
CONFIRM = 0.7
#: A notice may be wrapped over so many lines, of which all but the last have at most so many characters.
WRAP = 4
WRAP_CHARS = 120
UNKNOWN = "unknown"

#: Wording of licence notices, by family.
TEMPLATES = {
    "agpl": ["this program is free software licensed under the gnu affero general public license version 3", "you can redistribute it under the terms of the gnu affero general public license", "spdx license identifier agpl 3.0 or later", "license agpl 3.0", "license agplv3", "licensed under agpl 3.0", "licensed under the agplv3"],
    "apache": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www.apache.org licenses license 2.0", "spdx license identifier apache 2.0", "license apache 2.0", "license apache license 2.0", "licensed under apache 2.0", "licensed under apache license 2.0", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "bsd": ["redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "released under the bsd license", "use of this source code is governed by a bsd style license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause", "license bsd 3 clause", "license bsd 2 clause", "licensed under the bsd 3 clause license", "licensed under bsd 3 clause"],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "this work is licensed under a creative commons attribution 3.0 unported license", "spdx license identifier cc by 4.0", "license cc by 4.0", "licensed under cc by 3.0", "license cc by 3.0", "licensed under the cc by 3.0 license", "licensed under the cc by 4.0 license"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc sa 4.0", "licensed under cc by nc nd 4.0", "this work is licensed under a creative commons attribution noncommercial 3.0 unported license", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license", "this work is licensed under a creative commons attribution noncommercial sharealike 3.0 unported license", "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license", "this work is licensed under a creative commons attribution noncommercial noderivatives 3.0 unported license", "spdx license identifier cc by nc 4.0", "license cc by nc 4.0", "license cc by nc sa 4.0"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "text is available under the creative commons attribution sharealike license", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "this work is licensed under a creative commons attribution sharealike 3.0 unported license", "text is available under the creative commons attribution sharealike 4.0 license", "spdx license identifier cc by sa 4.0", "license cc by sa 4.0", "licensed under cc by sa 3.0"],
    "cc-by-nd": ["licensed under cc by nd 4.0", "licensed under cc by nd 3.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "this work is licensed under a creative commons attribution noderivatives 3.0 unported license", "this work is licensed under a creative commons attribution noderivs 3.0 unported license", "spdx license identifier cc by nd 4.0", "license cc by nd 4.0"],
    "cc0": ["this work is dedicated to the public domain", "waived all copyright and related rights to this work", "cc0 1.0 universal", "spdx license identifier cc0 1.0", "license cc0 1.0", "licensed under cc0 1.0", "licensed under the cc0 1.0 license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license as published by the free software foundation", "released under the gnu general public license version 2 or later gpl license", "spdx license identifier gpl 3.0 or later", "spdx license identifier gpl 2.0 only", "license gpl 3.0", "license gplv3", "licensed under gpl 3.0", "licensed under the gplv3", "license gpl 2.0", "license gplv2"],
    "lgpl": ["this library is licensed under the gnu lesser general public license version 2.1", "under the terms of the gnu lesser general public license lgpl license", "spdx license identifier lgpl 2.1 or later", "spdx license identifier lgpl 3.0", "license lgpl 2.1", "license lgpl 3.0", "license lgplv3", "licensed under lgpl 3.0", "licensed under lgpl 2.1", "licensed under the lgpl 2.1 license", "licensed under the lgpl 2.1 or later license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "spdx license identifier mit", "license mit", "license mit license", "licensed under mit"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0", "license mpl 2.0", "licensed under mpl 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "may be reproduced without the prior written permission of the publisher"],
}
#: Paragraphs with cue words that grant nothing.
NO_GRANT = [
    "you need a driving licence to rent a car in this country", "the restaurant lost its liquor license last year", "the court ruled on a copyright dispute between two publishers",
    "he asked for permission to leave the room", "a fishing license costs ten dollars at the town office", "the warranty covers parts and labour for two years",
    "she took poetic license with the story of the war", "the police issued a warrant for his arrest", "civil rights and public services were debated in the city council",
    "the new copyright law was discussed under the terms of an agreement", "the software has a license manager for the terms of use of each version", "the general public was not allowed without permission",
    "the ministry plans to redistribute land to small farmers", "the plate on the license of the old truck was red", "a broadcasting license was granted to the station", "the license fee for television rose again this year",
    "spdx license identifier zlib", "spdx license identifier unlicense", "spdx license identifier isc", "license zlib", "license see the file", "license unknown", "license none 2.0", "license 3.0 draft",
    "she renewed her driving license and mit researchers went home", "the apache people asked for permission to fish", "the license plate was by the door",
    "he said the apache license plate was released under the roof", "all rights reserved seats", "two rights reserved seats in the hall", "reserved seats and all rights of way", "licensed under the eclipse public license version 2.0",
    "license epl 2.0", "spdx license identifier epl 2.0", "released under the isc license", "licensed under the zlib license", "licensed under the terms of the european union public licence version 1.2", "released under the artistic license 2.0",
    "the work is licensed to a publisher", "the general public licensed the radio", "mit students released a licensed copy", "the creative commons attribution office", "the public domain is a concept of law", "this license is not valid", "no license is granted",
]
#: Names of licences and sentences that only calibrate the threshold.
UNSEEN = [
    "licensed under the open font license version 1.1", "license ofl 1.1", "spdx license identifier bsl 1.0", "released under the boost software license version 1.0", "licensed under the microsoft public license", "license wtfpl",
    "licensed under the common public license version 1.0", "licensed under the academic free license version 3.0", "this work is licensed under the open data commons attribution license", "licensed under the cecill 2.1 license",
    "the apache tribe was granted a license to fish under the treaty", "the mit museum needs a license for the exhibition", "mozilla made a licensed version of the public browser", "he has not released the source code under any license",
    "the domain is public and all work on it is dedicated", "copyright law reserves some rights", "the author has not waived all copyright", "you may not redistribute it under any terms", "a copy of the license hangs at the bar",
]
DENIABLE = {"licensed", "released", "dedicated", "available", "granted", "permitted", "governed", "subject", "waived"}
FILLER = "the of and a to in is it for on this that with as are be by from at or file project author team data page text copyright 2019 2021 contributors code site book article notes".split()


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.]*[a-z0-9]", text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def bigrams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]) for i in range(len(words) - 1)} or set(words)


@lru_cache(maxsize=1)
def naming() -> set[str]:
    """Words in templates of one or two families: without "sa" a notice of CC BY-SA is one of CC BY."""
    found = [set().union(*[words_of(s) for s in sentences]) for sentences in TEMPLATES.values()]
    return {w for w in set().union(*found) if sum(w in f for f in found) <= 2}


def denied(sentence: str) -> str | None:
    """The sentence with its grant denied, where it has a verb for that."""
    words = words_of(sentence)
    return " ".join(x for w in words for x in (["not", w] if w in DENIABLE else [w])) if DENIABLE & set(words) else None


@lru_cache(maxsize=1)
def template_weights() -> list[dict[str, int]]:
    """The 2-grams of each template: 2 where only its family uses them, else 1, and so many times that as it takes for those with a cue that the others don't suffice."""
    users: dict[str, set[str]] = {}
    for f, s in template_list():
        for g in bigrams_of(words_of(s)):
            users.setdefault(g, set()).add(f)
    out = []
    for _, s in template_list():
        base, times = {g: 1 + (len(users[g]) == 1) for g in bigrams_of(words_of(s))}, 1
        cue = {g for g in base if re.search(CUE, g)}
        while sum(v for g, v in base.items() if g not in cue) >= CONFIRM * sum(v * (times if g in cue else 1) for g, v in base.items()):
            times += 1
        out.append({g: v * (times if g in cue else 1) for g, v in base.items()})
    return out


def cue_is_safe() -> bool:
    """Does every template lose more than it may with the 2-grams that hold a cue? Each cue lies in one word."""
    return all(sum(v for g, v in w.items() if not re.search(CUE, g)) < CONFIRM * sum(w.values()) for w in template_weights())


def variants(sentence: str, rng: random.Random, n: int) -> list[list[str]]:
    """A notice within other words, with a word that names no family dropped now and then."""
    out = [words_of(sentence)]
    for _ in range(n):
        words = [w for w in words_of(sentence) if rng.random() > 0.03 or w in naming()]
        out.append(rng.choices(FILLER, k=rng.randrange(8)) + words + rng.choices(FILLER, k=rng.randrange(12)))
    return out


@lru_cache(maxsize=1)
def trained() -> dict:
    """families, bias, weights by gram, least posterior; the same on every call."""
    rng = random.Random(7)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    samples = [(families.index(f), w) for f in families[1:] for s in TEMPLATES[f] for w in variants(s, rng, 14)]
    refused = [d for x in TEMPLATES.values() for s in x if (d := denied(s))]
    for s in [*NO_GRANT, *refused]:
        samples += [(0, w) for w in variants(s, rng, 14)]
    rng.shuffle(samples)
    vocabulary = sorted(set().union(*[grams_of(words_of(s)) for x in [*TEMPLATES.values(), NO_GRANT, refused] for s in x]))
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(samples), len(vocabulary)))
    for i, (_, w) in enumerate(samples):
        x[i, [at[g] for g in grams_of(w) if g in at]] = 1
    y = np.eye(len(families))[[f for f, _ in samples]]
    held = np.arange(len(samples)) % 5 == 0
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for _ in range(250):
        z = x[~held] @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - y[~held]) / (~held).sum()
        w -= 2.0 * (x[~held].T @ g + 2e-4 * w)
        b -= 2.0 * g.sum(axis=0)
    w, b = np.rint(w * 1000).astype(int), np.rint(b * 1000).astype(int)
    aside = [(f, words) for (f, words), h in zip(samples, held, strict=True) if h] + [(0, v) for s in UNSEEN for v in variants(s, rng, 9)]
    least, weights, place = 0.5, template_weights(), [families.index(f) for f, _ in template_list()]
    for truth, words in aside:
        z = (b + sum((w[at[g]] for g in grams_of(words) if g in at), np.zeros(len(families)))) / 1000
        k, own = int(z.argmax()), bigrams_of(words)
        share = max([sum(v for g, v in t.items() if g in own) / sum(t.values()) for t, f in zip(weights, place, strict=True) if f == k], default=0.0)
        if k and k != truth and share >= CONFIRM:
            least = max(least, math.ceil(100 / float(np.exp(z - z.max()).sum()) + 1) / 100)
    return {"families": families, "bias": b.tolist(), "weights": {g: w[i].tolist() for g, i in at.items()}, "least": min(least, 0.95)}


def gram_rows() -> list[tuple[str, str, int, int]]:
    """(gram, kind, place, value): kind w has a class and its weight, kind t a template's number and 1."""
    rows = [(g, "w", k, v) for g, values in trained()["weights"].items() for k, v in enumerate(values) if v]
    return rows + [(g, "t", t, v) for t, w in enumerate(template_weights()) for g, v in sorted(w.items())]


def template_list() -> list[tuple[str, str]]:
    return [(f, s) for f in sorted(TEMPLATES) for s in TEMPLATES[f]]


def has_cue(text: Column) -> Column:
    """A plain search for each cue: the whole table goes through it."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in CUES]) | (F.contains(text, F.lit(CUE_WORD)) & text.rlike(CUE_WORD_AT))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, p): each document's distinct lines with a cue, and the runs of wrapped lines around them."""
    # column by column, so that a text is cut into lines once
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: has_cue(F.lower(F.element_at("lines", i)))))

    def run(i: Column, k: int, before: int) -> Column:
        first = i - before
        inside = (first >= 1) & (first + (k - 1) <= F.size("lines"))
        block = F.slice("lines", F.greatest(F.lit(1), first), k)
        wrapped = F.forall(block, lambda p: F.trim(p) != "") & F.forall(F.slice(block, 1, k - 1), lambda p: F.length(p) <= WRAP_CHARS)
        return F.when(inside & wrapped if k > 1 else inside, F.array_join(block, " "))

    every = F.flatten(F.transform("at", lambda i: F.array(*[run(i, k, before) for k in range(1, WRAP + 1) for before in range(k)])))
    # outer: an inner explode makes Spark test the array's size before, where it is made anew for every line
    return rows.select("doc_id", F.explode_outer(F.array_distinct(F.array_compact(every))).alias("p")).where("p is not null")


def grams(words: Column) -> Column:
    """Distinct 1- to 3-grams."""
    run = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(run(1), run(2), run(3)))


def classify(distinct: DataFrame) -> DataFrame:
    """(p, family, score, confirmed) of distinct paragraphs ``p``."""
    model, spark = trained(), distinct.sparkSession
    families, templates = model["families"], template_list()
    table = F.broadcast(spark.createDataFrame(gram_rows(), "gram string, kind string, place int, value int"))  # some thousand rows, fixed by the templates
    words = F.expr(r"regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9.]*[a-z0-9]', 0)")
    cut = distinct.withColumn("words", words).withColumn("gs", grams(F.col("words")))
    hits = cut.select("p", F.explode_outer("gs").alias("gram")).join(table, "gram").groupBy("p", "kind", "place").agg(F.sum("value").alias("value"))
    z = [F.coalesce(F.max(F.when((F.col("kind") == "w") & (F.col("place") == k), F.col("value"))), F.lit(0)) + model["bias"][k] for k in range(len(families))]
    size = [sum(w.values()) for w in template_weights()]
    share = lambda family: F.greatest(F.lit(0.0), *[F.coalesce(F.max(F.when((F.col("kind") == "t") & (F.col("place") == t), F.col("value"))), F.lit(0)) / F.lit(size[t]) for t, (f, _) in enumerate(templates) if f == family])
    rows = hits.groupBy("p").agg(F.array(*z).alias("z"), F.array(F.lit(0.0), *[share(f) for f in families[1:]]).alias("shares"))
    best = F.array_position("z", F.array_max("z")).cast("int")
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp((v - F.array_max("z")) / 1000.0))
    rows = rows.select("p", best.alias("best"), F.round(1 / total, 6).alias("score"), F.element_at("shares", best).alias("share"))
    family = F.element_at(F.array(*map(F.lit, families)), F.col("best"))
    sure = (F.col("best") > 1) & (F.col("score") >= model["least"]) & (F.col("share") >= CONFIRM)
    return rows.select("p", F.when(sure, family).otherwise(UNKNOWN).alias("family"), "score", sure.alias("confirmed"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs with cue words, n_confirmed, licenses (families in order, joined by commas), score (of the surest confirmed one, else 0)."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # written once: few paragraphs have a cue, and reading them again is cheaper than scanning every text again
    found = written(paragraphs(ids.where(has_cue(F.lower("text")))).distinct(), "paragraphs")
    scored = classify(found.select("p").distinct())
    # a line that a third of all documents hold is a hot key of this join; Spark splits it at run time
    named = found.join(scored, "p", "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.sum(F.coalesce("confirmed", F.lit(False)).cast("int")).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licenses"),
        F.coalesce(F.max(F.when(F.col("confirmed"), F.col("score"))), F.lit(0.0)).alias("score"),
    )
    every = ids.select("doc_id").distinct()
    rows = every.join(named, every["doc_id"].eqNullSafe(named["doc_id"]), "left")
    return rows.select(every["doc_id"], *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_paragraphs", "n_confirmed")], F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("score", F.lit(0.0)).alias("score"))


def licenses_sql() -> str:
    """DuckDB SQL for the rows of :func:`scan_licenses` over documents."""
    model, templates = trained(), template_list()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(g)}, '{k}', {i}, {v})" for g, k, i, v in gram_rows())
    classes = ", ".join(f"({k}, {quoted(f)}, {b})" for k, (f, b) in enumerate(zip(model["families"], model["bias"], strict=True)))
    sizes = ", ".join(f"({t}, {model['families'].index(f)}, {sum(template_weights()[t].values())})" for t, (f, _) in enumerate(templates))
    return f"""
with grams(gram, kind, place, value) as (values {values}), classes(k, family, bias) as (values {classes}), templates(t, k, size) as (values {sizes}),
lines as (select doc_id, string_split(text, chr(10)) as l from documents where regexp_matches(lower(text), '{CUE}')),
runs as (select doc_id, l[i : i + k - 1] as r, k from (select doc_id, l, k, unnest(range(1, len(l) - k + 2)) as i from lines, (select unnest(range(1, {WRAP + 1})) as k))),
cut as (select distinct doc_id, array_to_string(r, ' ') as p from runs where (k = 1 or (len(list_filter(r, lambda x: trim(x) = '')) = 0 and len(list_filter(r[1 : k - 1], lambda x: length(x) > {WRAP_CHARS})) = 0)) and regexp_matches(lower(array_to_string(r, ' ')), '{CUE}')),
words as (select p, regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9.]*[a-z0-9]') as w from (select distinct p from cut)),
places as (select p, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (values (1), (2), (3)) sizes(n)),
own as (select distinct p, n, array_to_string(w[i : i + n - 1], ' ') as gram from places),
hits as (select p, kind, place, sum(value) as value from own join grams using (gram) group by all),
z as (select p, k, family, bias + coalesce((select value from hits h where h.p = q.p and h.kind = 'w' and h.place = k), 0) as z from (select distinct p from hits) q, classes),
top as (select p, max(z) as m from z group by p),
scored as (select z.p, round(1.0 / sum(exp((z - m) / 1000.0)), 6) as score, min(k) filter (z = m) as k from z join top on z.p = top.p group by z.p),
shared as (select h.p, t.k, max(h.value / t.size::double) as share from hits h join templates t on h.kind = 't' and h.place = t.t group by h.p, t.k),
sure as (select s.p, c.family, s.score from scored s join classes c on c.k = s.k join shared h on h.p = s.p and h.k = s.k where s.k > 0 and s.score >= {model["least"]} and share >= {CONFIRM}),
named as (select doc_id, count(*) as n_paragraphs, count(family) as n_confirmed, coalesce(string_agg(distinct family, ',' order by family), '') as licenses, coalesce(max(score), 0) as score from cut left join sure on cut.p = sure.p group by doc_id)
select d.doc_id, coalesce(n_paragraphs, 0)::bigint as n_paragraphs, coalesce(n_confirmed, 0)::bigint as n_confirmed, coalesce(licenses, '') as licenses, coalesce(score, 0)::double as score
from (select distinct doc_id from documents) d left join named on named.doc_id is not distinct from d.doc_id
"""
