"""Per-worker caches from white-space runs of a text to fixed-size codes.

A text becomes the joined bytes of its runs' codes.  The cache is emptied when it is full, which
bounds memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import xxhash


class Learning(dict):
    """A dict that asks ``code`` for what it lacks."""

    def __init__(self, code: Callable):
        self._code = code

    def __missing__(self, key):
        found = self[key] = self._code(key)
        return found


class RunCache:
    """Joined codes of each text's runs; ``code`` maps one run (str or bytes) to bytes."""

    def __init__(self, code: Callable, limit: int = 150_000):
        self._limit, self._known = limit, Learning(code)

    def join(self, runs_of_texts: list[list]) -> list[bytes]:
        if len(self._known) > self._limit:
            self._known.clear()
        get = self._known.__getitem__
        return [b"".join(map(get, runs)) for runs in runs_of_texts]


def hash_code(run: bytes) -> bytes:
    return xxhash.xxh3_64_digest(run)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(sizes: Iterable[int], most: int) -> list[slice]:
    """Slices of consecutive items of about ``most`` together."""
    out, start, total, k = [], 0, 0, -1
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            out.append(slice(start, k + 1))
            start, total = k + 1, 0
    if start <= k:
        out.append(slice(start, k + 1))
    return out
