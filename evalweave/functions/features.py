"""Features of questions and answers, names of samples, tokens of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cues of a question's kind.
NUMERIC_CUES = r"\b(how many|number|date|year|amount|total|percent|value|phone|per 1000|time)\b"
DATE_CUES = r"\b(date|year|month|day|when|time)\b"
LAYOUT_CUES = r"\b(row|column|table|under|above|below|left|right|total|amount|value|per)\b"
CONSTRAINT_CUES = [" and ", " or ", " during ", " between ", " per ", " of the "]
FIELD_CUES = ["date", "year", "phone", "number", "amount", "total", "how many", "percent", "value"]
PLACE_CUES = ["according to", "during", "between", "from", "per", "under", "which", "where"]
JOIN_CUES = [" and ", " or ", " with ", " of the ", " in the "]
TOKEN_EDGES = "\"'`.,;:!?()[]{}"


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def holds_any(text: Column, cues: list[str]) -> Column:
    return F.greatest(*[F.contains(text, F.lit(c)) for c in cues])


def question_risk(question: Column) -> Column:
    """Points for length, numbers, fields, places and joined conditions of a lower-case question."""
    n = F.size(plain_words(question))
    points = [(n >= 10, 1), (n >= 18, 1), (question.rlike(NUMERIC_CUES), 2), (holds_any(question, FIELD_CUES), 2), (holds_any(question, PLACE_CUES), 1), (holds_any(question, JOIN_CUES), 1)]
    total = F.lit(0)
    for c, p in points:
        total = total + F.when(c, p).otherwise(0)
    return total


def answer_features(question: Column, answer: Column, target_tokens: Column) -> dict[str, Column]:
    """What is known before the full budget is paid: a question and the answer at the lowest budget; nulls count as empty, a flag is 0 or 1."""
    question, answer = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    low, asked, said = F.lower(question), plain_words(question), plain_words(answer)
    flag = lambda c: c.cast("double")
    count = lambda pattern: F.size(F.regexp_extract_all(answer, F.lit(f"({pattern})"), 1))
    numeric, digit = low.rlike(NUMERIC_CUES), answer.rlike(r"(?U)\d")
    return {
        "question_len": flag(F.size(asked)), "question_chars": flag(F.length(question)), "question_risk_score": flag(question_risk(low)), "target_text_token_count": F.coalesce(flag(target_tokens), F.lit(0.0)),
        "asks_numeric": flag(numeric), "asks_date": flag(low.rlike(DATE_CUES)), "asks_layout": flag(low.rlike(LAYOUT_CUES)), "question_multi_constraint": flag(holds_any(low, CONSTRAINT_CUES)),
        "low_answer_len": flag(F.size(said)), "low_answer_chars": flag(F.length(answer)), "low_answer_empty": flag(~answer.rlike(r"(?U)\S")), "low_answer_has_digit": flag(digit),
        "low_answer_repetition": flag((F.size(said) >= 6) & (F.size(F.array_distinct(F.slice(said, 1, 6))) <= 2)), "numeric_question_digit_missing": flag(numeric & ~digit),
        "low_answer_many_numbers": flag(count(r"(?U)\d+") >= 2), "low_answer_punctuation": flag(count(r"(?U)[^A-Za-z0-9\s]")),
    }


def answer_words(text: Column) -> Column:
    """Lower-case letters and digits parted by single spaces, commas dropped: the form in which answers of budgets are compared; null is empty."""
    return F.array_join(plain_words(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))), " ")


def evidence_units(text: Column) -> Column:
    """Parts of an answer between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def complexity(units: Column, stress: Column, reasons: Column) -> Column:
    """Class of an annotation task by what has failed, how many units there are and how the question is built; ``stress`` is an array of tags."""
    both = F.array_contains(stress, "multi_constraint_question") & F.array_contains(stress, "layout_field_question")
    return (
        F.when(F.contains(F.coalesce(reasons, F.lit("")), F.lit("persistent_failure")), "hard_persistent").when((F.size(units) >= 3) | F.coalesce(both, F.lit(False)), "likely_multi_region")
        .when(F.exists(units, lambda u: u.rlike(r"(?U)\d")) | F.coalesce(F.array_contains(stress, "numeric_answer"), F.lit(False)), "numeric_or_field").otherwise("single_region_likely")
    )


def token_form(text: Column) -> Column:
    """Trimmed, white space single, without quotes, brackets and full stops at either end; null is empty."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.btrim(squeezed, F.lit(TOKEN_EDGES))


def present_tokens(tokens: Column) -> Column:
    """Distinct lower-case forms of an array of tokens, first seen first."""
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.lower(token_form(t))), lambda t: t != ""))


def token_counts(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token, n): how often each form occurs."""
    form = F.lower(token_form(F.col("token")))
    return rows.select(key, F.explode(tokens).alias("token")).select(key, form.alias("token")).where("token <> ''").groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def choice_group(explicit: Column, identifier: Column, option: Column, dataset: Column, source: Column, image: Column, captions: Column) -> Column:
    """The explicit group, else the id without its option's suffix, else a digest of data set, source, image and captions; empty where nothing tells.

    The digest is of the compact JSON of those four, keys in order: groups agree with each other, not with digests made elsewhere.
    """
    suffix = F.concat(F.lit("-"), option.cast("string"))
    cut = F.when((identifier != "") & F.endswith(identifier, suffix), F.substr(identifier, F.lit(1), F.length(identifier) - F.length(suffix)))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.when(F.size(captions) > 0, F.concat(F.lit("choice-"), F.left(F.sha1(F.to_json(F.struct(captions.alias("captions"), blank(dataset).alias("dataset"), blank(image).alias("image_id"), blank(source).alias("source_dataset")))), F.lit(16))))
    own = F.trim(explicit)
    return F.coalesce(F.when(own != "", own), cut, digest, F.lit(""))


def selector_parts(name: Column) -> Column:
    """struct(selector, source) of a selector's name: what its prefix says about where relevance comes from."""
    low = F.lower(F.trim(name))
    without = lambda prefix: F.substr(low, F.lit(len(prefix) + 1))
    made = lambda s, source: F.struct(s.alias("selector"), F.lit(source).alias("source"))
    return F.when(low.startswith("target_embed_"), made(without("target_embed_"), "target_embedding")).when(low.startswith("embed_"), made(without("embed_"), "embedding")).otherwise(made(low, "evidence_oracle"))


def alias_variants(name: Column) -> Column:
    """Ways to write a category: as it is, with spaces for underscores, without spaces."""
    return F.array_distinct(F.array(name, F.replace(name, F.lit("_"), F.lit(" ")), F.replace(name, F.lit(" "), F.lit(""))))


def image_number(identifier: Column, path: Column) -> Column:
    """A whole-number image id, else the 6 to 12 digits that end the image's file name; null where neither is there."""
    own = F.when(identifier.cast("string") != "", identifier.cast("string"))
    return F.coalesce(own, F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"(?i)(\d{6,12})\.(?:jpg|jpeg|png)$", 1), F.lit(""))).try_cast("long")


def mutated_answer(answer: Column) -> Column:
    """A wrong answer of the same form: the last digit goes up by one, the last letter becomes X (Z for X), else an X is added."""
    body, last = F.substr(answer, F.lit(1), F.length(answer) - 1), F.right(answer, F.lit(1))
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", "not shown").when(last.rlike("^[0-9]$"), F.concat(body, ((last.try_cast("int") + 1) % 10).cast("string")))
        .when(last.rlike(r"^\p{L}$"), F.concat(body, F.when(F.upper(last) == "X", "Z").otherwise("X"))).otherwise(F.concat(answer, F.lit("X")))
    )


def shape_classes(text: Column) -> Column:
    """Which of letters, digits and other characters a text holds, joined by +."""
    parts = F.array_compact(F.array(F.when(text.rlike(r"\p{L}"), "alpha"), F.when(text.rlike(r"\p{N}"), "digit"), F.when(text.rlike(r"[^\p{L}\p{N}]"), "punct")))
    return F.when(F.size(parts) > 0, F.array_join(parts, "+")).otherwise("other")


def decoy_edit(source: Column, decoy: Column) -> Column:
    """Whether one replaced, or one left out or added, character makes a text of the other."""
    d = F.levenshtein(source, decoy)
    return F.when((d == 1) & (F.length(source) == F.length(decoy)), "single_substitution").when(d == 1, "single_deletion_or_insertion").otherwise("other")


def decoy_length(text: Column) -> Column:
    return F.when(F.length(text) <= 4, "4_or_less").when(F.length(text) <= 7, "5_to_7").otherwise("8_or_more")
