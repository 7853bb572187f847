"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over the bytes of a step of texts.

Words of up to :data:`LONG` bytes are hashed as polynomials modulo 2**64 over spread letters, all at once; such polynomials agree on
certain long words whatever the base is, so a longer word goes through a hash function of its own. A text that
is longer than a step is hashed piece by piece, cut between words, so that arrays per byte never grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from evalweave.llm.common import STEP_BYTES, steps

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
LONG = 48


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint64)
    fold[ord("A") : ord("Z") + 1] += np.uint64(32)
    space = np.zeros(256, dtype=bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return mix(fold + np.uint64(0x51)), space


LETTER, SPACE = _tables()
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        base = np.full(size, np.uint64(MULTIPLIER))
        back = np.full(size, np.uint64(pow(MULTIPLIER, -1, 1 << 64)))
        base[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(base), np.multiply.accumulate(back)]
    return _powers[0][:n], _powers[1][:n]


def long_word(raw: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(raw.tobytes().lower(), 0x51)


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts that begin at ``starts`` of ``raw`` (A-Z lowered), and the text it is in."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(LETTER[raw] * up, out=total[1:])
    inside = ~SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    edge[n] = True
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    last = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(last - first > LONG).tolist():
        hashes[i] = long_word(raw[first[i] : last[i]])
    return hashes, np.searchsorted(starts, first, side="right") - 1


def pieces(raw: np.ndarray, size: int = STEP_BYTES) -> Iterator[np.ndarray]:
    """``raw`` in pieces of about ``size`` bytes that end between words; a longer word is a piece of its own."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + size, n)
        if end < n:
            spaces = np.flatnonzero(SPACE[raw[at:end]])
            if len(spaces) and spaces[-1] > 0:
                end = at + int(spaces[-1])
            elif not len(spaces):
                while end < n and not (spaces := np.flatnonzero(SPACE[raw[end : end + size]])).size:
                    end = min(end + size, n)
                end += int(spaces[0]) if end < n else 0
            else:
                end = at + 1
        yield raw[at:end]
        at = end


def words_of_long(raw: np.ndarray, size: int = STEP_BYTES) -> np.ndarray:
    """Word hashes of one text, piece by piece."""
    out = []
    for piece in pieces(raw, size):
        if len(piece) > max(size, LONG):  # one word
            out.append(np.array([long_word(piece)], dtype=np.uint64))
        else:
            out.append(word_hashes(piece, np.zeros(1, np.int64))[0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int = 3, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each step of rows its first row and each row's sorted distinct shingle hashes.

    A text of fewer words than ``width`` is one shingle; one without words has none; null counts as empty.
    """
    for first, last in steps(texts, step_bytes):
        part = texts.slice(first, last - first)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = part.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        starts = offsets[:-1] - offsets[0]
        counts = np.zeros(len(part), dtype=np.int64)
        if len(raw) > step_bytes and len(part) == 1:
            words = words_of_long(raw, step_bytes)
            counts[0] = len(words)
        else:
            # texts without bytes have no place of their own: words are told apart by the others
            solid = np.flatnonzero(np.diff(offsets) > 0)
            words, owner = word_hashes(raw, starts[solid])
            counts[solid] = np.bincount(owner, minlength=len(solid))
        ends = np.cumsum(counts)
        rolled = mix(words)
        for k in range(1, width):
            rolled[: len(words) - k] = mix(rolled[: len(words) - k] * np.uint64(MULTIPLIER) + words[k:]) if len(words) > k else rolled[:0]
        sets = []
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            if not count:
                sets.append(np.zeros(0, np.uint64))
            elif count < width:
                whole = words[end - count]
                for w in words[end - count + 1 : end]:
                    whole = mix(np.array([whole], np.uint64) * np.uint64(MULTIPLIER) + w)[0]
                sets.append(np.array([mix(np.array([whole ^ np.uint64(count)], np.uint64))[0]], np.uint64))
            else:
                own = np.sort(rolled[end - count : end - width + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        yield first, sets
