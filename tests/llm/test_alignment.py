import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm import alignment
from evalweave.llm.alignment import ByteEncoder, align_tokens, aligner, encoded, pair_counts
from evalweave.llm.words_bpe import byte_letters

from .fixtures import DOC, awkward, empty, prose

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    byte = Tokenizer.from_file(BYTE)
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def tokens(libraries, text):
    """(A's tokens, B's tokens) as (id, bytes); None where they don't give the text."""
    byte, piece = libraries
    back = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(back[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + text, add_special_tokens=False).ids] if text else []
    b = []
    for i in piece.encode(text or ""):
        name = piece.id_to_piece(i)
        b.append((i, bytes([int(name[1:-1], 16)]) if piece.is_byte(i) else name.replace("▁", " ").encode()))
    whole = (" " + text).encode() if text else b""
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(found):
    at, out = 0, []
    for i, x in found:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, texts):
    rows, held = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(libraries, text))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([i for i, _, e in a if low < e <= high], [j for j, _, e in b if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]
        held.update(set(links))
        rows.append((a, b, groups, links))
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for a, b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out, held


AWKWARD = [
    "a", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a\t \nb", "x\n\n\ny  z\r\n", "don't I'll 'S we've", "12345 !! #a", "▁", "a▁b", "<|endoftext|> <s> <unk> <0x41>", "é漢🙂 日本語 　x", "\xa0 \xa0b", "  c", "\x1c d \x1f", "\x85e \x85",
    "a\x00b \x00", "   lead", "é Å", "᠎ b ᠎", "﻿x", "tab\tx \t y", "a ​ b", "-- -- --", "́ x",
]


def test_texts_against_the_libraries(libraries):
    rng = random.Random(5)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0 　aBé漢🙂's1.▁<|>"
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    flat, counts = ByteEncoder(BYTE).encode(texts)
    want = [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    got = aligner(BYTE, PIECE).align([*texts, None, ""])
    rows, _ = brute(libraries, [*texts, None, ""])
    each = [alignment._each(e).tolist() for e in (got.a_end, got.b_end, got.group_end, got.link_end)]
    assert list(zip(*each, aligner(BYTE, PIECE).digests(got), strict=True)) == [(*r[:4], r[6]) for r in rows]


def test_documents_against_brute_force(spark, libraries):
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + k, t, "en", "s", 0) for k, t in enumerate(AWKWARD)], DOC))
    docs = docs.unionByName(docs.where("doc_id in (0, 4, 12)")).where("doc_id is null or doc_id <> 10").repartition(5)
    given = docs.collect()
    odd = docs.withColumn("batch", F.lit(1)).withColumn("AT", F.lit("x")).withColumn("a`b", F.lit(2)).withColumn("_metadata", F.lit(3))
    got = sorted(map(str, ((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in align_tokens(odd, BYTE, PIECE).collect())))
    want, held = brute(libraries, [r.text for r in given])
    assert got == sorted(map(str, ((r.doc_id, *w) for r, w in zip(given, want, strict=True))))
    size = libraries[1].get_piece_size()
    assert {(r.pair // size, r.pair % size): r.docs for r in pair_counts(encoded(docs, BYTE, PIECE), size).collect()} == dict(held)


def test_groups_as_columns(spark, libraries):
    texts = ["don't look  back", None, "a▁b", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in align_tokens(docs, BYTE, PIECE, tokens=True).collect()}
    for i, text in enumerate(texts):
        a, b = tokens(libraries, text)
        r = rows[i]
        assert (r.a_ids, r.b_ids) == ([x for x, _ in a], [x for x, _ in b]) and sum(r.group_a) == r.n_a and sum(r.group_b) == r.n_b and len(r.group_a) == r.n_groups


def test_long_texts_in_pieces_and_windows(libraries, monkeypatch):
    text = prose(1, 4000, 900) + " é漢 " * 50 + "x" * 3000 + " 'tis  odd\n\n" * 40
    whole = aligner(BYTE, PIECE).align([text, "short one"])
    monkeypatch.setattr(alignment, "PIECE_CHARS", 500)
    monkeypatch.setattr(alignment, "WINDOW", 777)
    cut = aligner(BYTE, PIECE).align([text, "short one"])
    assert all((getattr(whole, k) == getattr(cut, k)).all() for k in ("a", "b", "a_end", "b_end", "link_a", "link_b", "place", "cut", "link_end", "group_end"))
    assert whole.a[: whole.a_end[0]].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_empty_tables_and_texts(spark):
    assert align_tokens(empty(spark), BYTE, PIECE).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, align_tokens(none, BYTE, PIECE).collect())) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        ByteEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_batches_are_numbered_apart(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text")).repartition(4)
    rows = encoded(docs, BYTE, PIECE).where("pair is not null").select("batch", "pair", "docs").collect()
    assert len({r.batch for r in rows}) == len(rows) == 4 and all(len(set(r.pair)) == len(r.pair) == len(r.docs) for r in rows)
    assert pa.types.is_integer(pa.array([rows[0].batch]).type)
