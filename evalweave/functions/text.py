"""Text normalisation, comparison, classification."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a character is misread as, by its lower case.
CONFUSABLE = {
    "0": "O 8 6", "1": "I l 7", "2": "Z 3", "3": "8 5", "4": "A 9", "5": "S 6", "6": "8 5", "7": "1 T", "8": "B 3 0", "9": "8 4", "a": "o e u", "b": "h d 8", "c": "e o", "d": "b cl", "e": "c a o", "f": "t l",
    "g": "q 9", "h": "b n", "i": "l 1", "j": "i", "k": "h", "l": "1 I i", "m": "rn n", "n": "h m", "o": "0 a e", "p": "b q", "q": "g p", "r": "n", "s": "5 S", "t": "f l", "u": "v n", "v": "u y", "w": "vv m",
    "x": "k", "y": "v", "z": "2 s",
}
PUNCTUATION = string.punctuation


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ascii_fold(text: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def answer_form(text: Column) -> Column:
    """Lower case without ASCII punctuation, then without articles, white space squeezed; letters of any script stay."""
    return squeeze(F.regexp_replace(plain_form(text), r"(?U)\b(a|an|the)\b", " "))


def plain_form(text: Column) -> Column:
    """:func:`answer_form` with its articles."""
    return squeeze(F.translate(F.lower(text), PUNCTUATION, ""))


def _unicode(form: str, fold: bool, strip: str | None) -> Callable:
    def normal(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            t = unicodedata.normalize(form, t.strip())
            t = t.casefold() if fold else t
            if strip == "space":
                return "".join(t.split())
            if strip == "alnum":
                return "".join(c for c in t if c.isalnum())
            if strip == "ascii":
                return "".join(c for c in unicodedata.normalize("NFKD", t) if c.isascii() and c.isalnum())
            return t

        return texts.map(one)

    return F.pandas_udf(normal, StringType())


#: Normalisers by name; those of Unicode forms have no built-in function.
NORMALISERS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim,
    "nfc": _unicode("NFC", False, None),
    "nfkc": _unicode("NFKC", False, None),
    "casefold": _unicode("NFKC", True, None),
    "nospace": _unicode("NFKC", True, "space"),
    "alnum": _unicode("NFKC", True, "alnum"),
    "ascii": _unicode("NFKC", True, "ascii"),
    "ascii_only": ascii_fold,
    "answer": answer_form,
    "plain_answer": plain_form,
}


def anls(a: Column, b: Column, most: float = 0.5) -> Column:
    """1 - edit distance over the longer length if that share is below ``most``, else 0; two empty texts agree."""
    longer = F.greatest(F.length(a), F.length(b))
    share = F.levenshtein(a, b) / longer
    return F.when(longer == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).when(share < most, 1 - share).otherwise(0.0)


def soft_accuracy(prediction: Column, answers: Column) -> Column:
    """Mean over the answers left out one by one of min(1, matches among the others / 3), all in :func:`answer_form`."""
    n, prediction, answers = F.size(answers), answer_form(prediction), F.transform(answers, answer_form)
    hits = F.size(F.filter(answers, lambda a: a == prediction))
    left_out = F.transform(answers, lambda a: F.least(F.lit(1.0), (hits - F.when(a == prediction, 1).otherwise(0)) / 3.0))
    return F.when(n > 0, F.aggregate(left_out, F.lit(0.0), lambda s, x: s + x) / n).otherwise(0.0)


def best_score(prediction: Column, golds: Column, metric: str = "anls") -> Column:
    if metric == "exact":
        return F.exists(golds, lambda g: answer_form(g) == answer_form(prediction)).cast("double")
    return F.coalesce(F.array_max(F.transform(golds, lambda g: anls(F.lower(F.trim(prediction)), F.lower(F.trim(g))))), F.lit(0.0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """The share of a's distinct elements that b has."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(0.0)


def contains_normalised(text: Column, target: Column) -> Column:
    """Does the text contain the target, both lowered and without anything but letters and digits of any script?"""
    fold = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return (fold(target) != "") & F.contains(fold(text), fold(target))


def usable_token(text: Column, least: int = 4, most: int = 18, punctuation: float = 0.35) -> Column:
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.length(text).between(least, most) & (kept > 0) & ((F.length(text) - kept) / F.length(text) <= punctuation)


def shape(text: Column) -> Column:
    return (
        F.when(text.rlike("^[0-9]+$"), "digits").when(text.rlike("^[A-Z]+$"), "upper").when(text.rlike("^[a-z]+$"), "lower")
        .when(text.rlike("^[A-Z][a-z]+$"), "title").when(text.rlike("[0-9]") & text.rlike("[A-Za-z]"), "alnum").otherwise("mixed")
    )


def length_bucket(n: Column) -> Column:
    return F.when(n <= 4, "short").when(n <= 8, "medium").otherwise("long")


def edit_kind(a: Column, b: Column) -> Column:
    d = F.levenshtein(a, b)
    return F.when(d == 0, "same").when((d == 1) & (F.length(a) == F.length(b)), "substitution").when((d == 1) & (F.length(a) > F.length(b)), "deletion").when(d == 1, "insertion").otherwise("other")


def changed_classes(a: Column, b: Column) -> Column:
    """Sorted classes (digit, letter, other) of characters that differ place by place."""
    kind = lambda c: F.when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^\p{L}$"), "letter").otherwise("other")
    cut = lambda t: F.split(t, "")
    pairs = F.zip_with(cut(a), cut(b), lambda x, y: F.when(~x.eqNullSafe(y), kind(F.coalesce(x, y))))
    return F.array_sort(F.array_distinct(F.filter(pairs, lambda k: k.isNotNull())))


def replacements(char: Column, unicode_safe: bool = True) -> Column:
    """What a character may be replaced by: its confusables, then the next letter or digit; upper case stays upper. ``unicode_safe`` leaves letters and digits outside ASCII alone."""
    low = F.lower(char)
    known = F.create_map(*[x for k, v in CONFUSABLE.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    letter, digit = ("^[A-Za-z]$", "^[0-9]$") if unicode_safe else (r"^\p{L}$", "^[0-9]$")
    following = F.when(char.rlike(letter), F.when(low == "z", "a").otherwise(F.chr(F.ascii(low) + 1))).when(char.rlike(digit), ((char.try_cast("int") + 1) % 10).cast("string"))
    made = F.array_compact(F.concat(F.coalesce(F.element_at(known, low), F.array().cast("array<string>")), F.array(following)))
    return F.when(char.rlike(r"^\p{Lu}$"), F.transform(made, F.upper)).otherwise(made)


def near_misses(word: Column, present: Column | None = None, unicode_safe: bool = True) -> Column:
    """Distinct decoys in order: each character replaced by each of its :func:`replacements`, then, of words of 4 or more, without each letter or digit.

    ``present`` holds lowered words that a decoy must not equal.
    """
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word)))
    at = lambda i: F.substr(word, i, F.lit(1))
    swapped = F.flatten(F.transform(places, lambda i: F.transform(replacements(at(i), unicode_safe), lambda c: F.concat(F.substr(word, F.lit(1), i - 1), c, F.substr(word, i + 1)))))
    shorter = F.transform(F.filter(places, lambda i: at(i).rlike(r"^[\p{L}\p{N}]$")), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    every = F.concat(F.when(F.length(word) > 0, swapped).otherwise(F.array().cast("array<string>")), F.when(F.length(word) >= 4, shorter).otherwise(F.array().cast("array<string>")))
    fresh = F.filter(every, lambda w: w != word)
    return F.array_distinct(fresh if present is None else F.filter(fresh, lambda w: ~F.array_contains(present, F.lower(w))))


def yes_no(text: Column) -> Column:
    """True for yes, y, true, 1 and what begins with yes; false for anything else, null included."""
    t = F.lower(F.trim(text.cast("string")))
    return F.coalesce(t.isin("yes", "y", "true", "1") | t.startswith("yes"), F.lit(False))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "-")


def subsequence_at(ids: Column, part: Column) -> Column:
    """0-based places where ``part`` begins in ``ids``."""
    n = F.size(part)
    starts = F.when(F.size(ids) >= n, F.sequence(F.lit(0), F.size(ids) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(ids, i + 1, n) == part)


def tags(rules: list[tuple[str, Column]]) -> Column:
    """Sorted names of the rules that hold."""
    return F.array_sort(F.filter(F.array(*[F.when(c, name) for name, c in rules]), lambda t: t.isNotNull()))


def ladder(rules: list[tuple[str, Column]], default: str) -> Column:
    """The first rule that holds; the order is part of the meaning."""
    out = F.when(rules[0][1], rules[0][0])
    for name, c in rules[1:]:
        out = out.when(c, name)
    return out.otherwise(default)


def target_positions(ids: Column, candidates: Column, pieces: Column, target: Column) -> Column:
    """0-based places of a target among a prompt's tokens, ascending: all places of the first of the candidate id lists that occurs in the prompt's ids, each occurrence; else of the tokens whose ``pieces`` of the decoded prompt overlap the target's first place in it, its case ignored where it isn't found as it is.

    ``candidates`` are the target's ids as it may be written (alone, after a space, in quotes). Empty without a place.
    """
    none = F.array().cast("array<int>")
    starts = lambda c: F.when((F.size(c) > 0) & (F.size(c) <= F.size(ids)), F.filter(F.sequence(F.lit(1), F.size(ids) - F.size(c) + 1), lambda i: F.slice(ids, i, F.size(c)) == c)).otherwise(none)
    places = lambda c: F.flatten(F.transform(starts(c), lambda i: F.sequence(i - 1, i + F.size(c) - 2)))
    found = F.get(F.filter(F.transform(candidates, places), lambda p: F.size(p) > 0), F.lit(0))
    whole = F.array_join(pieces, "")
    at = F.when(F.position(target, whole) > 0, F.position(target, whole)).otherwise(F.position(F.lower(target), F.lower(whole)))
    ends = F.transform(pieces, lambda p, i: F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    hit = lambda first: F.filter(F.transform(ends, lambda e, i: F.when((e >= first) & (e - F.length(F.get(pieces, i)) < first - 1 + F.length(target)) & (F.length(F.get(pieces, i)) > 0), i)), lambda i: i.isNotNull())
    decoded = F.when((at > 0) & (F.length(target) > 0), hit(at)).otherwise(none)
    return F.array_sort(F.array_distinct(F.coalesce(found, decoded)))
