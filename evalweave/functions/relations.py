"""Spatial relations as a small dimension table, relation names in free text, captions, focus terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The opposite of each relation; those without one are their own.
OPPOSITE = {
    "left_of": "right_of", "right_of": "left_of", "above": "below", "below": "above", "on": "below", "inside": "contains", "contains": "inside", "in_front_of": "behind", "behind": "in_front_of",
    "near": "far", "far": "near", "holding": "holding", "facing": "facing", "occluding": "occluding",
}
#: Families, in the order of their candidates.
FAMILIES = {
    "left_right": ["left_of", "right_of"], "vertical": ["above", "below", "on"], "topology": ["inside", "contains"], "proximity": ["near", "far"], "depth": ["in_front_of", "behind"],
    "interaction": ["holding", "facing", "occluding"],
}
#: A relation that supports another, with its weight; relations rewritten by swapping roles.
SUPPORT = {"on": ("above", 0.5)}
SWAPPED = {"right_of": "left_of", "below": "above", "contains": "inside", "behind": "in_front_of"}
#: Other names, after squeezing and cutting filler words.
SYNONYMS = {
    "left": "left_of", "leftof": "left_of", "left_of_of": "left_of", "right": "right_of", "rightof": "right_of", "right_of_of": "right_of", "over": "above", "top": "above", "on_top_of": "above",
    "under": "below", "beneath": "below", "bottom": "below", "underneath": "below", "front_of": "in_front_of", "next_to": "near", "beside": "near", "close_to": "near", "far_away_from": "far", "away_from": "far",
    "in": "inside", "inside_of": "inside", "within": "inside",
}
#: Phrases of captions.
PHRASES = {
    "at the left side of": "left_of", "on the left side of": "left_of", "to the left of": "left_of", "left side of": "left_of", "left of": "left_of", "at the right side of": "right_of",
    "on the right side of": "right_of", "to the right of": "right_of", "right side of": "right_of", "right of": "right_of", "to the behind of": "behind", "to the front of": "in_front_of",
    "to the bottom of": "below", "to the top of": "above", "in front of": "in_front_of", "far away from": "far", "on top of": "above", "next to": "near", "close to": "near", "inside of": "inside",
    "within": "inside", "inside": "inside", "underneath": "below", "contains": "contains", "holding": "holding", "facing": "facing", "occluding": "occluding", "behind": "behind", "above": "above",
    "below": "below", "under": "below", "over": "above", "near": "near", "on": "on", "in": "inside",
}
#: Words that name no field or entity.
FOCUS_STOP = """a an and answer are associated at be been being called can could did displayed do document does for from given had has have he her hers him his how image in is it may me mentioned might
mine my of on or our ours photo picture please read reads say says she should shown single that the their theirs them these they this those to using was were what when where which who why with word words would
written you your yours""".split()


def family_of(relation: str) -> str:
    return next((f for f, members in FAMILIES.items() if relation in members), "other")


def relation_table(spark: SparkSession) -> DataFrame:
    """One row per relation: opposite, both flips with the right and the wrong mapping, inverse for swapped roles ("" without), family, canonical form, anti and support relation, candidates."""
    rows = []
    for r, opposite in OPPOSITE.items():
        family = family_of(r)
        across = opposite if family == "left_right" else r
        upside = opposite if r in ("above", "below") else r
        wrong = lambda mapped: r if mapped != r else opposite  # noqa: B023, E731
        inverse = opposite if family in ("left_right", "topology", "depth") or r in ("above", "below") else ""
        support, weight = SUPPORT.get(r, ("", 0.0))
        more = ["on"] if family == "topology" else []
        candidates = [*FAMILIES.get(family, [r]), *more]
        candidates += [opposite] if opposite != r and opposite not in candidates else []
        rows.append((r, opposite, across, wrong(across), upside, wrong(upside), inverse, family, SWAPPED.get(r, r), r in SWAPPED, opposite if opposite != r else "", support, weight, candidates))
    return spark.createDataFrame(
        rows,
        "relation string, opposite string, flipped string, flipped_wrong string, upended string, upended_wrong string, inverse string, family string, canonical string, swaps boolean, anti string, support string, support_weight double, candidates array<string>",
    )


def normal_relation(text: Column) -> Column:
    t = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("-"), F.lit(" ")), r"\s+", " ")
    for filler in ("to the ", "at the ", "on the "):
        t = F.replace(t, F.lit(filler), F.lit(""))
    t = F.replace(F.replace(t, F.lit("side of"), F.lit("of")), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.coalesce(F.element_at(known, t), t)


def parse_caption(caption: Column, hint: Column | None = None) -> Column:
    """struct<relation, subject, object> at the longest phrase that the caption has; null without one.

    With the ``hint`` of a relation (not empty), only its own phrases count, or its name where it has none; a caption without any of them has the relation and empty names.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(caption), "^[\"']+|[\"']+$", ""), r"\s+", " "), r"[ .!?]+$", "")
    squeeze = lambda t: F.regexp_replace(F.regexp_replace(t, "^[ ,;:]+|[ ,;:]+$", ""), r"\s+", " ")
    article = lambda t: F.trim(F.regexp_replace(t, r"(?i)^(the|a|an)\s+", ""))

    def names(left: Column, right: Column, relation: Column) -> Column:
        subject = article(F.trim(F.regexp_replace(squeeze(left), r"(?i)\b(is|are|was|were|be|being)$", "")))
        target = article(F.trim(F.regexp_replace(squeeze(right), r"(?i)^(is|are|was|were|be|being)\b", "")))
        return F.struct(relation.alias("relation"), subject.alias("subject"), target.alias("object"))

    hint = None if hint is None else F.coalesce(hint, F.lit(""))
    out = None
    for phrase in sorted(PHRASES, key=len, reverse=True):
        pattern = rf"(?i)^(.*?)\b{re.escape(phrase)}\b(.*)$"
        found = names(F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2), F.lit(PHRASES[phrase]))
        there = clean.rlike(pattern) if hint is None else ((hint == "") | (hint == PHRASES[phrase])) & clean.rlike(pattern)
        out = F.when(there, found) if out is None else out.when(there, found)
    if hint is not None:
        own = F.concat(F.lit(r"(?i)^(.*?)\b\Q"), F.replace(hint, F.lit("_"), F.lit(" ")), F.lit(r"\E\b(.*)$"))
        unknown = (hint != "") & ~hint.isin(*sorted(set(PHRASES.values())))
        out = out.when(unknown & F.rlike(clean, own), names(*[F.call_function("regexp_extract", clean, own, F.lit(k)) for k in (1, 2)], hint))
        out = out.when(hint != "", F.struct(hint.alias("relation"), F.lit("").alias("subject"), F.lit("").alias("object")))
    return out


def family_column(relation: Column) -> Column:
    """The family of a relation; other for those of none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for f, members in FAMILIES.items() for m in members for x in (m, f)]), relation), F.lit("other"))


def allowed(relation: Column, relations: list[str] | None = None, families: list[str] | None = None) -> Column:
    """Whether a relation is one of the allowed ones and of an allowed family; an empty list allows all."""
    return (relation.isin(*relations) if relations else F.lit(True)) & (family_column(relation).isin(*families) if families else F.lit(True))


def focus_terms(question: Column, most: int = 8) -> Column:
    """The first distinct words that aren't stop words or single letters, in their spelling; the question itself without any."""
    words = F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*FOCUS_STOP) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    low = F.transform(kept, F.lower)
    first = F.filter(kept, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return F.when(F.size(first) > 0, F.slice(first, 1, most)).otherwise(F.array(F.trim(question)))


#: What stands between subject and object in a question; all but "contain" are asked with "Is".
ASKED = {
    "left_of": "to the left of", "right_of": "to the right of", "above": "above", "below": "below", "on": "on", "inside": "inside", "contains": "contain", "near": "near", "far": "far from",
    "in_front_of": "in front of", "behind": "behind", "holding": "holding", "facing": "facing", "occluding": "occluding",
}
#: Names that stand for none.
NO_NAME = ["", "none", "null", "nan"]


def clean_name(name: Column) -> Column:
    """A name, trimmed; empty for null and for words that stand for none."""
    own = F.trim(F.coalesce(name.cast("string"), F.lit("")))
    return F.when(F.lower(own).isin(*NO_NAME), "").otherwise(own)


def question_for(relation: Column, subject: Column, target: Column, question: Column | None = None) -> Column:
    """The yes/no question of a relation between two names; without both names, or for a relation without a wording, the sample's own question, its left and right turned the relation's way."""
    words = F.element_at(F.create_map(*[F.lit(x) for pair in ASKED.items() for x in pair]), relation)
    a, b = clean_name(subject), clean_name(target)
    own = F.trim(F.coalesce(question, F.lit(""))) if question is not None else F.lit("")
    turned = F.when(relation == "left_of", F.regexp_replace(own, r"(?i)\bright\b", "left")).when(relation == "right_of", F.regexp_replace(own, r"(?i)\bleft\b", "right")).otherwise(own)
    made = F.concat(F.when(relation == "contains", "Does ").otherwise("Is "), a, F.lit(" "), words, F.lit(" "), b, F.lit("?"))
    return F.coalesce(F.when((a != "") & (b != ""), made), turned)


def boxed_question(relation: Column) -> Column:
    phrase = F.replace(relation, F.lit("_"), F.lit(" "))
    return F.concat(F.lit(BOXED[0]), phrase, F.lit(BOXED[1]))


#: The question about two marked boxes, around the relation's phrase.
BOXED = ("In the image, a red box labeled A marks one object and a blue box labeled B marks another object. Is the red-boxed A object ", " the blue-boxed B object? Answer yes or no.")


def paraphrases(subject: Column, relation: Column, target: Column) -> Column:
    """Wordings of one question for agreement between them."""
    return reworded(question_for(relation, subject, target))


#: Wordings around a question, with its first letter lowered or as it is.
WORDINGS = ("According to the image, {low}?", "Look at the image carefully. {core}?", "Answer yes or no using only visual evidence: {low}?", "Based on what is visible, is it true that {low}?")


def reworded(question: Column) -> Column:
    core = F.regexp_replace(question, "[ ?]+$", "")
    low = F.concat(F.lower(F.substring(core, 1, 1)), F.substr(core, F.lit(2)))
    parts = lambda w: [low if p == "{low}" else core if p == "{core}" else F.lit(p) for p in re.split(r"(\{\w+\})", w) if p]
    return F.array(*[F.concat(*parts(w)) for w in WORDINGS])
