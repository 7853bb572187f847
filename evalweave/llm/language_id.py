"""Language identification, word first: a known word counts by its log frequency in each language; an unseen word backs off to character n-grams.

Words are runs of letters and marks, lowered. At each character of an unseen word the longest n-gram (5 characters down to 1, its ends at the word's
ends marked) that ends there and is known gives its log frequencies; the word's score is their mean, so that it weighs like a known word. A text's language has the largest sum;
its score is the posterior of the mean log frequencies, sharpened by at most ``EVIDENCE`` words.

The model is fitted on a bounded sample of labelled documents, whole texts, from documents that are not held out: about ``sample_docs`` a language, chosen by id hash, and about ``total_docs`` in all and :data:`TOTAL_BYTES` bytes, dealt evenly among
the languages, but ``LEAST_DOCS`` of each or all that it has; that bound is what limits the model, which holds every word and n-gram of the sample and is gathered and broadcast. It stores, for each of them, only the languages that have it; the others' log frequency is one number a
language and length. Every language takes part, however many there are. Language, source and id are never an input of a prediction.

A text of more than :data:`PIECE` characters is looked at piece by piece, cut at white space, with the same result but for the order of sums.

Cases: null texts and texts without a letter are "und" with score 0; without any labelled document every text is "und"; a row without lang teaches nothing;
a row without doc_id counts as held out; ties go to the language that sorts first; repeated rows get equal predictions; other columns are not read, and ride along whatever their names, but for those named as the two outputs, which are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import columns, others, ragged, small_batches, steps, written
from evalweave.llm.shingles import mix, powers

SAMPLE_DOCS = 2000
TOTAL_DOCS = 20_000
LEAST_DOCS = 8
#: Languages up to which their table, one row a language, is broadcast.
BROADCAST_LANGS = 10_000
LONGEST = 5
EVIDENCE = 20
BITS = 20
STEP = 1 << 19
#: Bytes of text that the sample holds in all, about, dealt evenly among the languages.
TOTAL_BYTES = 256 << 20
#: Characters of a text that are looked at together; words are never cut.
PIECE = 1 << 19
SPACE = re.compile(r"\s")

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, does it belong to words, its hash."""
    if not _tables:
        kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        letter = np.array([k == "L" for k in kind])
        word = letter | np.array([k == "M" for k in kind])
        _tables.extend([letter, word, mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(77))])
    return _tables[0], _tables[1], _tables[2]


def text_pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters that end at white space, which is in no word; a longer stretch without any is a piece of its own."""
    at = 0
    while len(text) - at > PIECE and (found := SPACE.search(text, at + PIECE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Words:
    """The words of some texts, and the hashes of their spans."""

    def __init__(self, texts: list[str]):
        letter, word, code_hash = tables()
        low = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(codes)
        self.up, self.down = powers(max(n, 1))
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code_hash[codes] * self.up[:n], out=self.total[1:])
        inside, edge = word[codes], np.zeros(n + 1, dtype=bool)
        edge[np.cumsum(lengths)] = True
        edge[0] = True
        self.first = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
        self.last = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1
        seen = np.concatenate([[0], np.cumsum(letter[codes])])
        some = seen[self.last] > seen[self.first]  # marks alone are no word
        self.first, self.last = self.first[some], self.last[some]
        self.text = np.searchsorted(np.cumsum(lengths), self.first, side="right")

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.total[last] - self.total[first]) * self.down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def hashes(self) -> np.ndarray:
        return mix(self.spans(self.first, self.last))

    def grams(self, ends: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams that end before ``ends`` in words from ``first`` to ``last``; the caller sees to it that they fit."""
        at = ends - n
        mark = (at == first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (ends == last).astype(np.uint64) * np.uint64(0xBEA225F9EB34556D)
        return mix(self.spans(at, ends) + mark)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, total_docs: int) -> DataFrame:
    """(lang, text) of the bounded sample."""
    doc_id, text, lang = columns([id_col, text_col, lang_col])
    rows = docs.select(doc_id.alias("id"), text.alias("text"), lang.alias("lang")).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).where("lang is not null and text is not null")
    counts = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "languages")  # a row a language
    langs = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    most = F.least(F.lit(float(sample_docs)), F.lit(float(total_docs)) / langs, F.lit(float(TOTAL_BYTES)) / langs / F.greatest(F.lit(1), F.col("bytes")) * F.col("n"))
    share = F.greatest(F.lit(float(LEAST_DOCS)), most) / F.col("n")
    place = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    shares = counts.select("lang", share.alias("share"))
    shares = F.broadcast(shares) if counts.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else shares
    return rows.join(shares, "lang").where(place < F.col("share")).select("lang", "text")


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, count): words with n = 0, character n-grams of every word."""
    for batch in batches:
        texts, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), dtype=object)
        for at, end in steps(texts, STEP):
            own = texts.slice(at, end - at).to_pylist()
            parts = [[p] for p in text_pieces(own[0])] if len(own) == 1 else [own]
            names, code = np.unique(langs[at:end].astype(str), return_inverse=True)
            for words, n in ((w, n) for w in map(Words, parts) for n in range(LONGEST + 1)):
                of = code[words.text]
                if n:
                    lengths = words.last - words.first
                    fit = np.flatnonzero(lengths >= n)
                    k = lengths[fit] - n + 1
                    ends, owner = ragged(words.first[fit] + n, k), np.repeat(fit, k)
                    gram, lang = words.grams(ends, words.first[owner], words.last[owner], n), of[owner]
                else:
                    gram, lang = words.hashes(), of
                for c, name in enumerate(names):
                    value, times = np.unique(gram[lang == c], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_pydict({"lang": [str(name)] * len(value), "n": np.full(len(value), n, np.int32), "gram": value.view(np.int64), "times": times.astype(np.int64)})


class Model:
    """Sorted gram hashes and, for each, the languages that have it and by how much its log frequency exceeds the language's for grams it doesn't have; length 0 is whole words."""

    def __init__(self, langs: list[str], rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], totals: np.ndarray):
        self.langs = langs
        self.absent = np.zeros((LONGEST + 1, len(langs)))
        self.tables: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(LONGEST + 1):
            gram, lang, times = rows.get(n, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)))
            by = np.lexsort((lang, gram))
            gram, lang, times = gram[by], lang[by], times[by]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            known = gram[first]
            self.absent[n] = np.log(0.5 / (totals[n] + 0.5 * max(1, len(known))))
            self.entries.append((np.append(first, len(gram)).astype(np.int64), lang.astype(np.int32), np.log((times + 0.5) / 0.5)))
            slots = (known >> np.uint64(64 - BITS)).astype(np.int64)
            start = np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << BITS))]).astype(np.int32)
            self.tables.append((known, start, int(np.diff(start).max()) if len(known) else 0))

    def find(self, n: int, gram: np.ndarray) -> np.ndarray:
        """The row of each gram, -1 where it is unknown."""
        known, start, deepest = self.tables[n]
        out = np.full(len(gram), -1, dtype=np.int64)
        slot = (gram >> np.uint64(64 - BITS)).astype(np.int64)
        first, last = start[slot], start[slot + 1]
        for k in range(deepest):
            live = np.flatnonzero(first + k < last)
            at = first[live] + k
            hit = known[at] == gram[live]
            out[live[hit]] = at[hit]
        return out

    def add(self, total: np.ndarray, n: int, row: np.ndarray, text: np.ndarray, weight: np.ndarray) -> None:
        """Add the weighted log frequencies of known grams to their texts' sums."""
        count, langs = len(total), len(self.langs)
        total += np.bincount(text, weights=weight, minlength=count)[:, None] * self.absent[n]
        starts, lang, more = self.entries[n]
        size = starts[row + 1] - starts[row]
        at = ragged(starts[row], size)
        total += np.bincount(np.repeat(text, size) * langs + lang[at], weights=np.repeat(weight, size) * more[at], minlength=count * langs).reshape(count, langs)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log frequency of each text's words in each language, and the number of words. A long text is looked at piece by piece, so that arrays per character never grow with it."""
        if len(texts) == 1 and len(texts[0]) > PIECE:
            total, count = np.zeros((1, len(self.langs))), np.zeros(1, np.int64)
            for piece in text_pieces(texts[0]):
                mean, n = self._scores([piece])
                total, count = total + mean * n[:, None], count + n
            return total / np.maximum(count, 1)[:, None], count
        return self._scores(texts)

    def _scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        row = self.find(0, words.hashes())
        total = np.zeros((len(texts), len(self.langs)))
        known = row >= 0
        self.add(total, 0, row[known], words.text[known], np.ones(int(known.sum())))
        unseen = np.flatnonzero(~known)
        if len(unseen):
            first, last, text = words.first[unseen], words.last[unseen], words.text[unseen]
            size = last - first
            ends, owner = ragged(first + 1, size), np.repeat(np.arange(len(unseen)), size)
            left = np.arange(len(ends))
            for n in range(LONGEST, 0, -1):
                fit = left[ends[left] - n >= first[owner[left]]]
                found = self.find(n, words.grams(ends[fit], first[owner[fit]], last[owner[fit]], n))
                hit = fit[found >= 0]
                self.add(total, n, found[found >= 0], text[owner[hit]], 1.0 / size[owner[hit]])
                done = np.zeros(len(ends), dtype=bool)
                done[hit] = True
                left = left[~done[left]]
        count = np.bincount(words.text, minlength=len(texts))
        return total / np.maximum(count, 1)[:, None], count


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, total_docs: int = TOTAL_DOCS) -> Model:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, id_col, text_col, lang_col, sample_docs, total_docs)
    kept = rows.mapInArrow(count_grams, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")).toArrow()
    if not kept.num_rows:
        return Model([], {}, np.ones((LONGEST + 1, 0)))
    coded = kept["lang"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    langs, place = np.unique(np.array(coded.dictionary.to_pylist(), dtype=object).astype(str), return_inverse=True)
    code = place[coded.indices.to_numpy()]
    n, gram, times = kept["n"].to_numpy(), kept["gram"].to_numpy().astype(np.int64).view(np.uint64), kept["times"].to_numpy().astype(np.float64)
    totals = np.bincount(n * len(langs) + code, weights=times, minlength=(LONGEST + 1) * len(langs)).reshape(LONGEST + 1, len(langs))
    by_n = {k: np.flatnonzero(n == k) for k in range(LONGEST + 1)}
    return Model(langs.tolist(), {k: (gram[at], code[at], times[at]) for k, at in by_n.items() if len(at)}, totals)


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The carried columns of ``docs`` with the predicted language and its score."""
    small_batches(docs.sparkSession)
    kept = others(docs.columns if carry is None else carry, [lang_name, score_name])
    # plain names inside, as PySpark can't hand columns with a backtick in their name to Python
    plain = [f"c{i}" for i in range(len(kept))]
    carried = docs.select(*[c.alias(n) for c, n in zip(columns(kept), plain, strict=True)], columns([text_col])[0].alias("text"))
    schema = carried.drop("text").schema.add("lang", "string").add("score", "double")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, last in steps(texts, STEP):
                if own.langs:
                    mean, count = own.scores([t or "" for t in texts.slice(first, last - first).to_pylist()])
                    odds = mean * np.minimum(count, EVIDENCE)[:, None]
                    best = odds.argmax(axis=1)
                    score = 1 / np.exp(odds - odds.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    count, best, score = np.zeros(last - first, np.int64), np.zeros(last - first, np.int64), np.zeros(last - first)
                names = [own.langs[b] if c else "und" for b, c in zip(best.tolist(), count.tolist(), strict=True)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(count > 0, score, 0.0))], names=[*plain, "lang", "score"])

    return carried.mapInArrow(predicted, schema).toDF(*kept, lang_name, score_name)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(rows, fit(docs), carry=["doc_id", "held_out"])
