"""Exact, word-cached use of a public word BPE vocabulary.

The vocabulary drops white space and splits on it before anything else, so a text's ids are the
concatenated ids of its white-space runs.  Words of Latin letters go straight to the vocabulary's
merges, past its normaliser and splitter, which would leave them as they are.  Each run's ids are
cached as little-endian bytes; the caches are emptied when they are full, which bounds memory and
changes no result.
"""

from __future__ import annotations

import os
import re

import numpy as np

from siltwork.llm.chunks import Learning

#: Signs that end a word of letters and are one run of their own for the vocabulary's splitter.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: str.split() splits on these, the vocabulary's own splitter does not; special tokens need the whole text.
_RARE = "\x1c", "\x1d", "\x1e", "\x1f", "<|"
#: The vocabulary spells bytes as signs: a visible Latin-1 sign for its own byte, the other bytes from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}
_PER_PROCESS: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """``raw(texts)`` has the bytes of ``Tokenizer.encode(text, add_special_tokens=False).ids`` of each text."""

    def __init__(self, path: str, cache_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._limit = cache_words
        self._words, self._cores, self._tails = Learning(self._word), Learning(self._core), Learning(self._encode)

    def _encode(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        spelt = core if core.isascii() else "".join([_SPELT[b] for b in core.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self._merge(spelt)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if not core.isalpha() or not (core.isascii() or _LATIN.fullmatch(core)):
            return self._encode(word)
        ids = self._cores[core.lower()]
        return ids + self._tails[word[len(core) :]] if len(core) < len(word) else ids

    def raw(self, texts: list[str]) -> list[bytes]:
        if max(len(self._words), len(self._cores), len(self._tails)) > self._limit:
            self.forget()
        get = self._words.__getitem__
        return [self._encode(text) if any(x in text for x in _RARE) else b"".join(map(get, text.split())) for text in texts]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw([text])[0], "<u4")

    def forget(self) -> None:
        """Empty the caches: a worker that waits for other tasks should hold the vocabulary only."""
        for cache in (self._words, self._cores, self._tails):
            cache.clear()

    @classmethod
    def of_process(cls, path: str) -> "WordTokenizer":
        """One tokenizer for all tasks that a Python worker runs."""
        if path not in _PER_PROCESS:
            _PER_PROCESS[path] = cls(path)
        return _PER_PROCESS[path]

