"""Hashes of words and of runs of words, for a whole batch of texts at a time.

Words are runs of anything but ASCII white space, as they stand. Every hash has 64 bits and depends on nothing but the
words, so that batches of any size agree.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from shelfcast.llm.common import raw_text

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = scramble(np.arange(1, 257, dtype=np.uint64))


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_BACK, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """The words of a batch of texts: ``starts`` and ``ends`` in bytes, ``hashes``, and ``first``, the n + 1 offsets of the texts among the words."""

    def __init__(self, texts: pa.Array):
        self.body, self.offsets = raw_text(texts)
        n = len(self.body)
        solid = ~_SPACE[self.body]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~solid[:-1] | cut[1:n]
        after[:-1] = ~solid[1:] | cut[1:n]
        self.starts = np.flatnonzero(solid & before)
        self.ends = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        up, down = _powers(1 << max(16, int(n + 1).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.body] * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        self.hashes = self.bytes_hashes(self.starts, self.ends)

    def bytes_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes a to b, for arrays of ends; those of a word are the word's."""
        return scramble((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(np.uint64))

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one text, and the word at which each run starts."""
        total = len(self.hashes) - size + 1
        if total <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        part = scramble(self.hashes + _U(seed)) if seed else self.hashes
        done, span, out = 0, 1, None
        while True:
            if size & span:
                piece = part[done : done + total]
                out = piece if out is None else pair(out, piece)
                done += span
            if done == size:
                break
            part = pair(part[:-span], part[span:])
            span *= 2
        at = np.flatnonzero(self.owner[:total] == self.owner[size - 1 :])
        return out[at], at


    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words a to b, for arrays of ends."""
        up, down = _powers(1 << max(16, int(len(self.hashes) + 1).bit_length()))
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=sums[1:])
        return scramble((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    x = a * _U(0xA0761D6478BD642F) + b
    x = x ^ (x >> _U(29))
    x = x * _U(0xE7037ED1A0B428DB)
    return x ^ (x >> _U(32))
