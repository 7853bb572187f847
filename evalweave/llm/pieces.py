"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is normalised as the model says (identity: each space becomes U+2581, one more in front), cut into
words before each U+2581 that follows another character — no piece has one inside — and each distinct word
of a step is encoded once. All words' symbols stand in one flat array. A round finds, for each word, the
smallest rank among its adjacent pairs and merges its places from the left: all of them where no piece made from the
merged one ranks before it, else places too far apart to touch one another, so that the library's one-by-one order gives the same symbols.
Words without a pair that merges leave; a word whose smallest rank belongs to several pieces (runs of spaces) is finished by a heap, as the order within such ties runs from left to right.
What is left and isn't a piece becomes its UTF-8 bytes.

Cases: a null or empty text encodes to nothing but the end id; control pieces written out in a text are ordinary text; lone
surrogates can't occur in Spark strings. Columns besides the text are carried along untouched.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.common import columns, list_column, others, small_batches, steps
from evalweave.llm.word_cache import WordCache

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, BYTE = 1, 2, 6
NEVER = np.iinfo(np.int32).max


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a serialised protocol buffer message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        spec, trainer = (dict(_fields(next(v for k, v in message if k == n))) for n in (3, 2))
        if trainer.get(3) != 2 or not trainer.get(35) or spec.get(1) != b"identity" or spec.get(4, 1) != 0 or not spec.get(3, 1):
            raise ValueError("only BPE models with byte fallback and the identity normaliser, a space put in front, white space kept")
        pieces = [dict(_fields(v)) for k, v in message if k == 1]
        self.text = [p[1].decode() for p in pieces]
        kind = [p.get(3, NORMAL) for p in pieces]
        if set(kind) - {NORMAL, UNKNOWN, 3, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        score = {self.text[i]: struct.unpack("<f", p.get(2, b"\0" * 4))[0] for i, p in enumerate(pieces) if kind[i] == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in score):
            raise ValueError("a piece has a space inside")
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, k in enumerate(kind):
            if k == BYTE:
                self.byte_id[int(self.text[i][1:-1], 16)] = i
        self.size = len(pieces)
        ids = {t: i for i, t in enumerate(self.text) if t in score and kind[i] == NORMAL}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.size, NEVER, dtype=np.int32)
        for t, i in ids.items():
            self.rank[i] = order[score[t]]
        self.ids = ids
        #: Every way to put a piece together from two, keyed by left * size + right.
        pairs = [(ids[t[:k]] * self.size + ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_key, self.pair_piece = table[:, 0].copy(), table[:, 1].astype(np.int32)
        #: Pieces whose places can merge at once: no piece made from them ranks as high, none shares their rank.
        left, right = self.pair_key // self.size, self.pair_key % self.size
        shared = np.bincount(self.rank[self.rank < NEVER])
        self.tied = np.append(shared > 1, False)
        self.safe = self.rank < NEVER
        self.apart = 2 * max(map(len, ids)) + 2
        early = self.rank[self.pair_piece] <= self.rank[left]
        self.safe[left[early]] = False
        early = self.rank[self.pair_piece] <= self.rank[right]
        self.safe[right[early]] = False
        bits = 18
        while True:  # enough slots for short chains
            self.bits = bits
            slots = self._slot(self.pair_key)
            if np.bincount(slots).max() <= 6 or bits == 24:
                break
            bits += 1
        by = np.argsort(slots, kind="stable")
        count = np.bincount(slots, minlength=1 << bits)
        self.bucket = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.bucket_key, self.bucket_piece = self.pair_key[by], self.pair_piece[by]
        self.deepest = int(count.max())
        self.chars = {t: i for t, i in ids.items() if len(t) == 1}
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for t, i in self.chars.items():
            self.char_id[ord(t)] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces makes; -1 where there is none."""
        out = np.full(len(left), -1, dtype=np.int32)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[both].astype(np.int64) * self.size + right[both]
        slot = self._slot(key)
        first, last = self.bucket[slot], self.bucket[slot + 1]
        for k in range(self.deepest):
            live = np.flatnonzero(first + k < last)
            if not len(live):
                break
            at = first[live] + k
            hit = self.bucket_key[at] == key[live]
            out[both[live[hit]]] = self.bucket_piece[at[hit]]
        return out

    def _finish(self, word: np.ndarray, place: np.ndarray, piece: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """What is left of the symbols when the best pair, the leftmost among equals, merges one by one."""
        pieces, words, n = piece.tolist(), word.tolist(), len(piece)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and words[i] == words[j] and pieces[i] >= 0 and pieces[j] >= 0:
                key = pieces[i] * self.size + pieces[j]
                k = int(np.searchsorted(self.pair_key, key))
                if k < len(self.pair_key) and self.pair_key[k] == key:
                    made = int(self.pair_piece[k])
                    heapq.heappush(heap, (int(self.rank[made]), i, j, pieces[i], pieces[j], made))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, i, j, left, right, made = heapq.heappop(heap)
            if gone[i] or gone[j] or pieces[i] != left or pieces[j] != right or after[i] != j:
                continue
            pieces[i], gone[j], after[i] = made, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        keep = ~np.array(gone)
        return place[keep], np.array(pieces, dtype=np.int32)[keep], code[keep]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        piece = self.char_id[codes]
        code = np.where(piece < 0, codes, -1)  # of a character that is no piece
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes))
        done: list[tuple[np.ndarray, ...]] = []
        pair = np.where(word[1:] == word[:-1], self.merged(piece[:-1], piece[1:]), -1).astype(np.int32) if len(piece) > 1 else np.zeros(0, np.int32)
        pair = np.append(pair, -1).astype(np.int32)[: len(piece)]
        while len(piece):
            rank = np.where(pair >= 0, self.rank[pair], NEVER)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            if (over := least == NEVER).any():  # compaction: words without a pair leave
                leave = np.repeat(over, sizes)
                done.append((place[leave], piece[leave], code[leave]))
                stay = ~leave
                word, place, piece, code, pair, rank = (x[stay] for x in (word, place, piece, code, pair, rank))
                sizes, least = sizes[~over], least[~over]
                if not len(piece):
                    break
                starts = np.cumsum(sizes) - sizes
            if (over := self.tied[least]).any():
                leave = np.repeat(over, sizes)
                done.append(self._finish(word[leave], place[leave], piece[leave], code[leave]))
                stay = ~leave
                word, place, piece, code, pair, rank = (x[stay] for x in (word, place, piece, code, pair, rank))
                sizes, least = sizes[~over], least[~over]
                if not len(piece):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            group = np.searchsorted(starts, hits, side="right") - 1
            lead = np.concatenate([[True], group[1:] != group[:-1]])
            run = np.flatnonzero(lead | np.concatenate([[True], np.diff(hits) != 1]))
            odd = (hits - np.repeat(hits[run], np.diff(np.append(run, len(hits))))) & 1
            # of a safe piece all places, every other one where they overlap; of others the first of each row of near ones
            far = lead | np.concatenate([[True], np.diff(place[hits]) > self.apart])
            take = lead | np.where(self.safe[pair[hits]], odd == 0, far)
            at = hits[take]
            piece[at] = pair[at]
            keep = np.ones(len(piece), dtype=bool)
            keep[at + 1] = False
            changed = np.zeros(len(piece), dtype=bool)
            changed[at] = True
            word, place, piece, code, pair, changed = (x[keep] for x in (word, place, piece, code, pair, changed))
            touched = changed.copy()
            touched[:-1] |= changed[1:]  # the pair on the left, too
            at = np.flatnonzero(touched)
            inner = at[(at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])]
            pair[at] = -1
            pair[inner] = self.merged(piece[inner], piece[inner + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        place, piece, code = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(place)
        place, piece, code = place[by], piece[by], code[by]
        owner = np.searchsorted(np.cumsum(lengths), place, side="right")
        size = np.ones(len(piece), dtype=np.int64)
        odd = np.flatnonzero(piece < 0)
        if len(odd):
            blobs = [chr(c).encode() for c in code[odd].tolist()]
            size[odd] = [len(b) for b in blobs]
            flat = np.repeat(piece, size)
            ends = np.cumsum(size)
            for k, b in zip(odd.tolist(), blobs, strict=True):
                flat[ends[k] - len(b) : ends[k]] = self.byte_id[list(b)]
        else:
            flat = piece
        return flat, np.bincount(owner, weights=size, minlength=len(words)).astype(np.int64)


class PieceEncoder:
    """A model, the words that this process has met, and the library for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = PieceModel(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = WordCache(self._cut, lambda words: self.model.words([SPACE + w for w in words])).encode

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Words of the normalised text without the U+2581 that each begins with."""
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or SPACE in text:
            return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def decode(self, lists: list[list[int]]) -> list[str]:
        return self.library.decode(lists, num_threads=1) if lists else []


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    """This process's encoder; Python workers live on from task to task, and so does what it knows."""
    if model_path not in _encoders:
        _encoders[model_path] = PieceEncoder(model_path)
    return _encoders[model_path]


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, end: bool = True) -> DataFrame:
    """``docs`` with the ids of each text and, if ``decoded_col`` is named, the text that they decode to.

    Columns of the same name as an output, whatever its case, are replaced.
    """
    small_batches(docs.sparkSession)
    named = [c for c in (ids_col, decoded_col) if c]
    free = others(docs.columns, named)
    rest = [f for f in docs.schema.fields if f.name in free]
    # plain names inside, as PySpark can't hand columns with a backtick in their name to Python
    plain = [f"c{i}" for i in range(len(rest))]
    schema = T.StructType([*[T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, rest, strict=True)], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.StringType())] if decoded_col else [])])
    kept = [f.name for f in rest]
    where = next((n for n, c in zip(plain, kept, strict=True) if c.lower() == text_col.lower()), "text")
    carried = [c.alias(n) for c, n in zip(columns(kept), plain, strict=True)] + ([columns([text_col])[0].alias("text")] if where == "text" else [])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(where))
            for first, last in steps(texts):
                flat, counts = own.encode([t or "" for t in texts.slice(first, last - first).to_pylist()])
                if end:
                    ends = np.cumsum(counts + 1)
                    put = np.ones(len(flat) + len(counts), dtype=bool)
                    put[ends - 1] = False
                    both = np.full(len(put), own.library.eos_id(), dtype=np.int32)
                    both[put] = flat
                    flat, counts = both, counts + 1
                part = batch.slice(first, last - first)
                arrays = [part.column(part.schema.get_field_index(c)) for c in plain]
                arrays.append(list_column(flat.astype(np.int32), counts, pa.int32()))
                if decoded_col:
                    cut = np.cumsum(counts).tolist()
                    ids = flat.tolist()
                    arrays.append(pa.array(own.decode([ids[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]), type=pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*carried).mapInArrow(encoded, schema).toDF(*kept, *named)


def decode_pieces(ids: DataFrame, model_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``ids`` with the text of each list of ids; null stays null."""
    small_batches(ids.sparkSession)
    free = others(ids.columns, [decoded_col])
    rest = [f for f in ids.schema.fields if f.name in free]
    plain = [f"c{i}" for i in range(len(rest))]
    schema = T.StructType([*[T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, rest, strict=True)], T.StructField("decoded", T.StringType())])
    where = next(n for n, f in zip(plain, rest, strict=True) if f.name.lower() == ids_col.lower())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(part.schema.get_field_index(where)).to_pylist()
                texts = iter(own.decode([x for x in lists if x is not None]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if x is None else next(texts) for x in lists], type=pa.string())], schema=pa.schema([*part.schema, pa.field("decoded", pa.string())]))

    return ids.select(*[c.alias(n) for c, n in zip(columns([f.name for f in rest]), plain, strict=True)]).mapInArrow(decoded, schema).toDF(*[f.name for f in rest], decoded_col)


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """n_tokens, ids_sha256 and decoded_sha256 of the columns that :func:`encode_pieces` adds."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return [F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256")]
