"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(spark):
    base = prose(1, 120)
    near = base.replace(" w", " w", 1).split(" ")
    near[60] = "changed"
    far = [w if i % 7 else f"x{i}" for i, w in enumerate(base.split(" "))]
    rows = [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, " ".join(near), "en", "b"), (3, " ".join(far), "de", "b"), (4, None, "en", None), (5, "", None, "a"), (6, " \t\n ", "de", "a"), (7, "one two", "en", "c"), (8, "ONE two", "en", "c"),
        (9, prose(2, 6000, 50_000), "de", "c"), (10, "x" * 40_000, "en", "a"), (11, "é漢🙂 ▁▁ <s> <|endoftext|> 'S don't  12", "fr", "a"), (12, "12345 !!", "fr", "a"), (None, "no id here", "en", "a"), (13, base.upper(), "en", "a"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)
