"""Encoding texts word by word behind a bounded cache of ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

from evalweave.llm.common import ragged

#: Words that a cache keeps; what comes after that is encoded anew in each step. Longer words are never kept.
CACHE_WORDS = 400_000
CACHE_CHARS = 64


class WordCache:
    """``encode(texts)``: flat ids of all texts, and the number of ids of each.

    ``cut`` gives the words of a text whose ids, one after the other, are the text's;
    ``fresh`` gives the flat ids of distinct words and the number of ids of each.
    """

    def __init__(self, cut: Callable, fresh: Callable, words: int = CACHE_WORDS, chars: int = CACHE_CHARS):
        self.cut, self.fresh, self.words, self.chars = cut, fresh, words, chars
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _store(self, words: list[str], at: int) -> None:
        flat, counts = self.fresh(words)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), dtype=np.uint32)])
        if at + len(words) > len(self.start):
            more = np.zeros(max(len(self.start), len(words)), dtype=np.int64)
            self.start, self.count = np.concatenate([self.start, more]), np.concatenate([self.count, more])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[at : at + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[at : at + len(words)] = counts
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = list(map(self.cut, texts))
        per_row = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        words = list(chain.from_iterable(rows))
        index, used = self.index, self.used
        at = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh = sorted({words[i] for i in unknown.tolist()})
            kept = [w for w in fresh if len(w) <= self.chars][: max(0, self.words - len(index))]
            if kept:
                self._store(kept, len(index))
                index.update(zip(kept, range(len(index), len(index) + len(kept)), strict=True))
                used = self.used
            also: dict[str, int] = {}
            if len(kept) < len(fresh):
                passing = sorted(set(fresh).difference(kept))
                self._store(passing, len(index))
                also = {w: len(index) + k for k, w in enumerate(passing)}
            at[unknown] = [also[w] if w in also else index[w] for w in (words[i] for i in unknown.tolist())]
        counts = self.count[at]
        flat = self.ids[ragged(self.start[at], counts)]
        self.used = used
        total = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(total[np.concatenate([[0], np.cumsum(per_row)])])
