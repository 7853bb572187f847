import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm.common import scratch, shared_dir
from evalweave.llm.pieces import PieceEncoder, decode_pieces, digests, encode_pieces
from evalweave.llm.token_files import read_token_files, token_files, with_bases, write_token_files
from evalweave.llm.word_cache import WordCache
from evalweave.llm.words_bpe import ChunkEncoder

from .fixtures import awkward, empty

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "▁", "a", "in", "the", "The", "é", "É", "漢", "🙂", "́", "<s>", "<|endoftext|>", "'s", "don't", "12", ".", ", ", ". ", "ing", "tion", "İ", "ΑΣ", "\x1c", "\x85", "\xa0", " " * 17, "aaaa", "zq" * 9]
texts = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30)


@pytest.fixture(scope="module")
def encoders():
    return ChunkEncoder(WORD), Tokenizer.from_file(WORD), PieceEncoder(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_words_equal_the_library(encoders, text):
    flat, counts = encoders[0].encode([text])
    assert flat.tolist() == encoders[1].encode(text, add_special_tokens=False).ids and counts.tolist() == [len(flat)]


@settings(max_examples=400, deadline=None)
@given(text=texts)
def test_pieces_equal_the_library(encoders, text):
    text = text.encode("utf-8", "ignore").decode()
    flat, _ = encoders[2].encode([text])
    assert flat.tolist() == encoders[3].encode(text)


@pytest.mark.parametrize("alphabet", ["ab", " ", "etaoinshrdlu", "-=_*#", "a "])
def test_long_words_equal_the_library(encoders, alphabet):
    rng = random.Random(5)
    text = "".join(rng.choice(alphabet) for _ in range(9000))
    assert encoders[2].encode([text])[0].tolist() == encoders[3].encode(text)


def test_another_tokenizer_goes_through_the_library(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    made, library = ChunkEncoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    texts = ["The Cat's  HAT, 12", "", "É\tx"]
    flat, counts = made.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and counts.tolist() == list(map(len, want)) and want[0] != Tokenizer.from_file(WORD).encode(texts[0], add_special_tokens=False).ids


def test_a_full_cache_changes_nothing():
    fresh = lambda words: (np.array([ord(c) for w in words for c in w], dtype=np.uint32), np.array([len(w) for w in words]))
    small, large = WordCache(str.split, fresh, words=2), WordCache(str.split, fresh)
    for text in ["a bb a", "ccc bb d " + "e" * 100, "", "d d a ccc"]:
        assert [x.tolist() for x in small.encode([text, "bb"])] == [x.tolist() for x in large.encode([text, "bb"])]


def test_token_files_hold_the_ids(spark):
    docs = awkward(spark).where("doc_id is not null")
    tokenizer = Tokenizer.from_file(WORD)
    rows = sorted(docs.collect())
    got = {r.doc_id: r for r in token_files(spark, docs, WORD).collect()}
    start = 0
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_read_back_ids_and_repeats(spark):
    docs = awkward(spark).where("doc_id in (7, 8, 5)")
    docs = docs.unionByName(docs.where("doc_id = 7"))
    folder = scratch(spark, "t")
    manifest = write_token_files(docs, folder, WORD, 1, width=32, parts=2).cache()
    rows = sorted(read_token_files(with_bases(manifest)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [5, 7, 7, 8] and rows[0].ids == [1] and rows[1].ids == rows[2].ids == rows[3].ids


def test_the_manifest_of_many_parts_is_one_file(spark):
    """Each file that an executor writes by Hadoop's local file system costs processes of its own."""
    folder = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    before = {*folder.glob("token-files-*-manifest")}
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("the text").alias("text"))
    assert token_files(spark, docs, WORD).count() == 40
    (made,) = {*folder.glob("token-files-*-manifest")} - before
    assert len(list(made.glob("part-*"))) == 1 and spark.read.parquet(str(made)).count() == 4


def test_token_files_refuse_a_null_id_and_take_an_empty_table(spark):
    assert token_files(spark, empty(spark), WORD).count() == 0
    with pytest.raises(Exception, match="without doc_id"):
        token_files(spark, awkward(spark), WORD).count()


def test_pieces_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = awkward(spark).withColumn("ids", F.lit("taken"))
    made = encode_pieces(docs, PIECE, decoded_col="decoded")
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    for r in made.select("text", "decoded", "ids", *digests(made)).collect():
        ids = [*library.encode(r.text or ""), library.eos_id()]
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    again = decode_pieces(made.select("doc_id", "ids"), PIECE).join(made.select("doc_id", F.col("decoded").alias("d")), "doc_id")
    assert again.where("decoded <> d").count() == 0
    assert encode_pieces(empty(spark), PIECE).count() == 0
