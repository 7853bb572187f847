"""Alignment of two tokenizers over the bytes of each text, and how often the corpus links each pair of their tokens.

A is a byte-level BPE that reads a space and the text, B a SentencePiece BPE that puts the space in front itself, so that both cover the same bytes. A whole Arrow batch is one string of bytes, each document at an
offset of its own. The ends of A's and of B's tokens are counted by place, once; places that hold an end cut the batch into links (one A token and one B token that overlap, each such pair once), and places that hold both cut it into groups.
Running sums over the places say which token a link belongs to and which group; their values at the documents' ends recover what belongs to each document. (Window by window of :data:`WINDOW` bytes, so that counts per byte never grow with the batch or the text.)

Pair counts, how many documents hold a pair linked, need the whole corpus and go back to every document:

1. A batch sums its documents' distinct pairs, so that a pair is one row of each batch (:func:`encoded`, written).
2. Pairs are summed over all batches; a pair that is its A token's most frequent one is marked (:func:`pair_counts`, written).
3. Each batch's pairs meet their counts in a join on the pair (a hot pair is a row a batch, far fewer than its documents), go back to their batch, and the batch's documents, sorted behind them, sum up what they need.

So nothing grows with the vocabularies in one place: no table of pairs is gathered or broadcast, and documents move once, as the places of their pairs among their batch's.

Cases: a null or empty text, or one whose tokens don't give its bytes (a U+2581 in it reads as a space), has no tokens: zeros and an empty string; special tokens written out in a text are plain text. Each row counts as a document, rows that repeat an id or a text too, and null ids are carried along.
Pairs of equal count are all their A token's best. An empty table gives no rows. Columns besides the id and the text are not read, whatever their names. Texts over :data:`PIECE_CHARS` are tokenized piece by piece, cut between two ASCII marks or letters around a
single space, where neither tokenizer's tokens reach across; a text without such a place is one piece.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm import pieces
from evalweave.llm.common import columns, list_column, ragged, small_batches, written
from evalweave.llm.word_cache import WordCache
from evalweave.llm.words_bpe import byte_letters

#: Characters that are tokenized at a time.
PIECE_CHARS = 1 << 20
#: Bytes whose ends are counted at a time.
WINDOW = 1 << 21
#: Tokens whose bytes are compared with the text at a time.
CHECKED = 1 << 17
#: Pairs of a batch in a row.
REQUEST = 4096

#: Two white-space characters in a row, or one at the end.
ODD = re.compile(r"\s\s|\s\Z")
#: A space that begins a token whatever stands before it: what follows is surely no white space.
BEGIN = re.compile(" (?=[!-~\xa1-ᙿ、-퟿])")
#: A space where both tokenizers surely cut.
BETWEEN = re.compile("(?<=[!-~]) (?=[!-~])")


class ByteEncoder:
    """A byte-level BPE from a ``tokenizers`` file. ``encode(texts)`` gives the flat ids of all texts, each with a space in front, and the number of ids of each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not all(t["special"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level BPE tokenizers without a normaliser, a prefix space or added tokens that are not special")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in byte_letters().items()}
        size = self.tokenizer.get_vocab_size()
        special = {t["id"] for t in spec["added_tokens"]}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.token_bytes = [n.encode() if i in special else bytes(back[c] for c in n) for i, n in enumerate(names)]
        # the usual pattern never lets a token go on past a space that begins a word
        self.by_words = bool(first.get("use_regex", True))
        self.encode = WordCache(self._cut, self._whole).encode if self.by_words else self._whole

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Parts of the text, each encoded with a space in front."""
        if not text:
            return []
        if not text[0].isspace() and not ODD.search(text):
            return text.split(" ")
        parts = BEGIN.split(" " + text)
        return [parts[0][1:], *parts[1:]] if parts[0] else parts[1:]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)] if texts else []
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.concatenate([np.array(x, dtype=np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32), counts


def piece_bytes(encoder: pieces.PieceEncoder) -> list[bytes]:
    """The bytes that each piece stands for."""
    out = [t.replace(pieces.SPACE, " ").encode() for t in encoder.model.text]
    for byte, i in enumerate(encoder.model.byte_id.tolist()):
        out[i] = bytes([byte])
    return out


class ByteTable:
    """Tokens' bytes by id."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.length[ids])]


@dataclass
class Alignment:
    """A batch's tokens and links, document after document; ``*_end`` are running totals at the documents' ends."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    #: Of each link: its A token, its B token, its last byte, and whether a group ends with it.
    link_a: np.ndarray
    link_b: np.ndarray
    place: np.ndarray
    cut: np.ndarray
    link_end: np.ndarray
    group_end: np.ndarray

    def group_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of A and of B tokens up to each group's end."""
        at = np.flatnonzero(self.cut)
        return self.link_a[at] + 1, self.link_b[at] + 1


def _ends(totals: np.ndarray) -> np.ndarray:
    return np.cumsum(totals)


def _each(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0)


class Aligner:
    """Two tokenizers, the bytes of their tokens, and the decimal digits of ids."""

    def __init__(self, a_path: str, b_path: str):
        self.encoder_a, self.encoder_b = ByteEncoder(a_path), pieces.encoder(b_path)
        self.a, self.b = ByteTable(self.encoder_a.token_bytes), ByteTable(piece_bytes(self.encoder_b))
        self.size_a, self.size_b = len(self.a.length), len(self.b.length)
        most = max(self.size_a, self.size_b)
        self.digits = np.zeros((most, len(str(most)) + 1), dtype=np.uint8)
        for width in range(1, len(str(most)) + 1):
            first, last = (0 if width == 1 else 10 ** (width - 1)), min(most, 10**width)
            for k in range(width):
                self.digits[first:last, k] = 48 + np.arange(first, last) // 10 ** (width - 1 - k) % 10

    def _pieces(self, text: str) -> list[str]:
        if len(text) <= PIECE_CHARS or not self.encoder_a.by_words:
            return [text]
        out, at = [], 0
        while len(text) - at > PIECE_CHARS and (found := BETWEEN.search(text, at + PIECE_CHARS)):
            out.append(text[at : found.start()])
            at = found.end()
        return [*out, text[at:]]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Flat ids of A, the number of each text, and the same of B."""
        rows = [self._pieces(t) if t else [] for t in texts]
        flat = [p for row in rows for p in row]
        owner = np.repeat(np.arange(len(texts)), [len(row) for row in rows])
        out = []
        for encode in (self.encoder_a.encode, self.encoder_b.encode):
            ids, counts, at = [], [], 0
            while at < len(flat):
                end, chars = at + 1, len(flat[at])
                while end < len(flat) and chars + len(flat[end]) <= PIECE_CHARS:
                    chars += len(flat[end])
                    end += 1
                found, each = encode(flat[at:end])
                ids.append(found.astype(np.int32))
                counts.append(each)
                at = end
            out += [np.concatenate(ids) if ids else np.zeros(0, np.int32), np.bincount(owner, weights=np.concatenate(counts) if counts else None, minlength=len(texts)).astype(np.int64)]
        return out

    def align(self, texts: list[str | None]) -> Alignment:
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        a, n_a, b, n_b = self._encoded([t or "" for t in texts])
        docs = np.arange(len(texts))
        fits = np.ones(len(texts), dtype=bool)
        for table, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            fits &= np.bincount(np.repeat(docs, n), weights=table.length[ids], minlength=len(texts)).astype(np.int64) == size
        for table, ids, n in ((self.a, a, n_a), (self.b, b, n_b)):
            want = np.frombuffer(b"".join(r for r, ok in zip(raw, fits.tolist(), strict=True) if ok), dtype=np.uint8)
            own, ends, at = ids[np.repeat(fits, n)], _ends(np.where(fits, size, 0)), 0
            for first in range(0, len(own), CHECKED):  # few tokens' bytes at a time
                made = table.joined(own[first : first + CHECKED])
                wrong = np.flatnonzero(made != want[at : at + len(made)])
                fits[np.unique(np.searchsorted(ends, at + wrong, side="right"))] = False
                at += len(made)
        a, b, n_a, n_b, size = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)], n_a * fits, n_b * fits, size * fits
        place, is_a, is_b = self._places(_ends(self.a.length[a]), _ends(self.b.length[b]))
        cut = is_a & is_b
        link_end = np.searchsorted(place, _ends(size) - 1, side="right")
        return Alignment(a, b, _ends(n_a), _ends(n_b), np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, place, cut, link_end, np.concatenate([[0], np.cumsum(cut)])[link_end])

    @staticmethod
    def _places(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """The last byte of each link, and whether an A token and a B token ends there."""
        total = int(ends_a[-1]) if len(ends_a) else 0
        found = []
        for at in range(0, max(total, 1), WINDOW):
            counts = [np.bincount(e[slice(*np.searchsorted(e, [at + 1, at + WINDOW + 1]))] - 1 - at, minlength=min(WINDOW, total - at)) > 0 for e in (ends_a, ends_b)]
            place = np.flatnonzero(counts[0] | counts[1])
            found.append((place + at, counts[0][place], counts[1][place]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def digests(self, made: Alignment) -> list[str]:
        """SHA-256 of each document's groups as text, a1,a2|b1;a3|b2,b3; an empty string without tokens."""
        upto_a, upto_b = made.group_counts()
        if not len(upto_a):
            return [""] * len(made.a_end)
        # A tokens of a group stand before its B tokens
        at_a = np.arange(len(made.a)) + np.repeat(upto_b - _each(upto_b), _each(upto_a))
        at_b = np.arange(len(made.b)) + np.repeat(upto_a, _each(upto_b))
        out = np.empty((len(made.a) + len(made.b), self.digits.shape[1]), dtype=np.uint8)
        out[at_a], out[at_b] = self.digits[made.a], self.digits[made.b]
        out[:, -1] = ord(",")
        out[at_a[upto_a - 1], -1] = ord("|")
        out[at_b[upto_b - 1], -1] = ord(";")
        ends = (made.a_end + made.b_end).tolist()
        texts = (out[first:last].tobytes().translate(None, b"\0") for first, last in zip([0, *ends[:-1]], ends, strict=True))
        return [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in texts]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner; Python workers live on from task to task, and so does what it knows."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
TOKENS = "a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>"
#: Rows of documents have ``at`` and ``times``: places among their batch's pairs, and links of each. Rows of pairs have ``first`` (the place of the first), ``pair`` and ``docs``.
BATCH = f"batch long, {DOCUMENT}, at array<int>, times array<int>, first int, pair array<long>, docs array<int>, {TOKENS}"


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """Rows of documents and of their batches' distinct pairs; see BATCH. A pair is a_id * (number of B's ids) + b_id.

    With ``tokens``, documents also carry their ids and the number of tokens of either kind in each group.
    """
    names = [f.split()[0] for f in BATCH.split(", ")]
    kinds = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in BATCH.split(", ")}

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c].cast(kinds[c]) if c in given else pa.nulls(n, kinds[c]) for c in names], names=names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        span = own.size_a * own.size_b
        for k, batch in enumerate(batches):
            number = TaskContext.get().partitionId() << 32 | k
            got = own.align(batch.column("text").to_pylist())
            n, links = batch.num_rows, _each(got.link_end)
            pair = got.a[got.link_a].astype(np.int64) * own.size_b + got.b[got.link_b]
            held, times = np.unique(np.repeat(np.arange(n), links) * span + pair, return_counts=True)
            pairs, at = np.unique(held % span, return_inverse=True)
            entries = np.bincount(held // span, minlength=n)
            given = {"batch": pa.array(np.full(n, number)), "doc_id": batch.column("doc_id"), "n_links": pa.array(links), "groups_sha256": pa.array(own.digests(got), pa.string())}
            given |= {c: pa.array(_each(e)) for c, e in (("n_a", got.a_end), ("n_b", got.b_end), ("n_groups", got.group_end))}
            given |= {"at": list_column(at, entries, pa.int32()), "times": list_column(times, entries, pa.int32())}
            if tokens:
                groups = given["n_groups"].to_numpy()
                given |= {"a_ids": list_column(got.a, _each(got.a_end), pa.int32()), "b_ids": list_column(got.b, _each(got.b_end), pa.int32())}
                given |= {c: list_column(_each(upto), groups, pa.int32()) for c, upto in zip(("group_a", "group_b"), got.group_counts(), strict=True)}
            for first in range(0, n, 256):  # rows of arrays: few at a time
                yield rows(min(256, n - first), **{c: v.slice(first, 256) for c, v in given.items()})
            if len(pairs):
                first = np.arange(0, len(pairs), REQUEST)
                sizes = np.minimum(REQUEST, len(pairs) - first)
                yield rows(len(first), batch=pa.array(np.full(len(first), number)), first=pa.array(first), pair=list_column(pairs, sizes, pa.int64()), docs=list_column(np.bincount(at), sizes, pa.int32()))

    small_batches(docs.sparkSession)
    key, text = columns([id_col, text_col])
    return docs.select(key.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(made, BATCH)


def pair_counts(batches: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best) of every linked pair of ids: how many documents hold it, and whether no pair of its A id is in more."""
    each = batches.where("pair is not null").select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.docs").alias("docs"))
    each = written(each, "pairs").withColumn("a", F.expr(f"pair div {size_b}"))
    most = each.groupBy("a").agg(F.max("docs").alias("most"))
    return written(each.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its A id's most frequent), count_sum (pairs' documents over links), groups_sha256.

    With ``tokens``, also a_ids, b_ids, and group_a and group_b: the number of tokens of each group. See the module.
    """
    size_b = len(pieces.encoder(b_path).model.text)
    batches = written(encoded(docs, a_path, b_path, id_col, text_col, tokens), "aligned")
    counts = pair_counts(batches, size_b)
    asked = batches.where("pair is not null").select("batch", "first", F.posexplode("pair").alias("k", "pair"))
    answers = asked.join(counts, "pair").select("batch", (F.col("first") + F.col("k")).alias("place"), (F.col("docs") * 2 + F.col("best").cast("long")).alias("answer"))
    named = [f.split()[0] for f in f"{DOCUMENT}, at array<int>, times array<int>, {TOKENS}".split(", ")]
    given = batches.where("pair is null").select("batch", *named)
    out = [f for f in f"{DOCUMENT}, n_best long, count_sum long".split(", ")] + (TOKENS.split(", ") if tokens else [])
    kept = [f.split()[0] for f in out if f.split()[0] not in ("n_best", "count_sum")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answer = None, np.zeros(0, np.int64)
        for batch in batches:
            number, place = batch.column("batch").to_numpy(), batch.column("place").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
            for first, last in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if number[first] != now:
                    now, answer = number[first], np.zeros(0, np.int64)
                # answers, in the order of their places, come before documents
                some = int((place[first:last] >= 0).sum())
                answer = np.concatenate([answer, batch.column("answer").slice(first, some).to_numpy(zero_copy_only=False).astype(np.int64)])
                part = batch.slice(first + some, last - first - some)
                at, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "times"))
                ends = np.cumsum(np.diff(part.column("at").offsets.to_numpy())) if part.num_rows else np.zeros(0, np.int64)
                found = answer[at]
                sums = [np.diff(np.concatenate([[0], np.cumsum(v * times)])[ends], prepend=0) for v in (found & 1, found >> 1)]
                values = {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
                names = [f.split()[0] for f in out]
                yield pa.RecordBatch.from_arrays([values[c] if c in values else part.column(c) for c in names], names=names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = [F.lit(None).cast(dict(given.dtypes)[c]).alias(c) for c in named]
    both = given.select("batch", F.lit(-1).alias("place"), F.lit(None).cast("long").alias("answer"), *named).unionByName(answers.select("batch", "place", "answer", *nothing))
    placed = both.repartition(n, "batch").sortWithinPartitions("batch", (F.col("place") < 0).cast("int"), "place").select("batch", "place", "answer", "at", "times", *kept)
    return placed.mapInArrow(summed, ", ".join(out))
