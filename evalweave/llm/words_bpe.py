"""Encoding whole texts with a ``tokenizers`` model behind a bounded cache.

The tokenizer's rules never look across a space or a line feed, so a text's ids are those of its
chunks between them, one after the other. A chunk of plain Latin letters, digits and ASCII marks
splits further into the pre-tokens that the tokenizer's own pattern gives, and each goes through the library's merge model. Any other chunk goes
through the whole library. This holds for tokenizers with the rules named in :data:`RULES`; with any other, whole texts go through the library. In texts of such chunks without two adjacent marks, a full stop or comma at a chunk's end is a pre-token of its own and case doesn't matter, so that fewer chunks differ.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from evalweave.llm.word_cache import WordCache

#: Letters that are whole code points under NFC and whose lower case is one letter.
LATIN = "\xe0-\xf6\xf8-\xffĀ-įı-ſ"
SIMPLE = re.compile(rf"[!-~\xc0-\xd6\xd8-\xde{LATIN}]*")
PLAIN = re.compile(rf"[ \n!-~\xc0-\xd6\xd8-\xde{LATIN}]*")
MARKS = re.compile(rf"[^ \na-zA-Z0-9\xc0-\xd6\xd8-\xde{LATIN}]{{2}}")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")


#: What a tokenizer file must say for chunks to be encoded by themselves.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}


def known_rules(tokenizer_path: str) -> bool:
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and " " not in t["content"] for t in spec["added_tokens"])
    return whole and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(spec.get(k) == v for k, v in RULES.items())


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level models: itself where it prints, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ChunkEncoder:
    """``encode(texts)`` gives the flat ids of all texts and the number of ids of each."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.encode = WordCache(self._cut, self._fresh).encode if known_rules(tokenizer_path) else self._whole

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(counts.sum())), counts

    @staticmethod
    def _cut(text: str) -> list[str]:
        text = text.replace("\n", " ")
        if PLAIN.fullmatch(text) and not MARKS.search(text):
            return text.lower().replace(". ", " . ").replace(", ", " , ").split(" ")
        return text.split(" ")

    def _token(self, token: str) -> list[int]:
        return [t.id for t in self.model.tokenize(token if token.isascii() else token.encode().decode("latin-1").translate(self.letters))]

    def _chunk(self, chunk: str) -> list[int]:
        if not chunk:
            return []
        if chunk.isascii() and chunk.isalpha():
            return self._token(chunk.lower())
        if "<|" in chunk or not SIMPLE.fullmatch(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return [i for t in SPLIT.findall(chunk.lower()) for i in self._token(t)]

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = list(map(self._chunk, chunks))
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(counts.sum())), counts


_encoders: dict[str, ChunkEncoder] = {}


def encoder(tokenizer_path: str) -> ChunkEncoder:
    """This process's encoder; Python workers live on from task to task, and so does what it knows."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = ChunkEncoder(tokenizer_path)
    return _encoders[tokenizer_path]
