"""Encoding by distinct chunks: a batch's text is cut into chunks that a tokenizer treats independently, each distinct
chunk is encoded once, and the ids of the whole batch are gathered from a pool, which knows chunks by their bytes.  The
pool belongs to one task and starts anew when it passes its limits, so memory is bounded; results never depend on it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .textvec import distinct, gather

MAX_CHUNKS, MAX_BYTES = 300_000, 64 << 20


class ChunkPool:
    """encode: list of chunk bytes -> their ids end to end, and the number of ids of each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], max_chunks: int = MAX_CHUNKS):
        self.encode, self.max_chunks = encode, max_chunks
        self.clear()

    def clear(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.held = 0
        self.start, self.length, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def ids(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and how many each has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        first, inverse = distinct(buf, start, end)
        if self.seen and (len(self.seen) + len(first) > self.max_chunks or self.held > MAX_BYTES):
            self.clear()
        data = buf.tobytes()
        known, spans = self.seen.get, list(zip(start[first].tolist(), end[first].tolist(), strict=True))
        at = [known(data[s:e], -1) for s, e in spans]
        new = [i for i, x in enumerate(at) if x < 0]
        if new:
            keys = [data[s:e] for s, e in map(spans.__getitem__, new)]
            got = self.encode(keys)
            n0 = len(self.seen)
            for i, (k, own) in enumerate(zip(new, keys, strict=True)):
                at[k] = self.seen[own] = n0 + i
                self.held += len(own)
            self._add(n0, *got)
        at = np.array(at)[inverse]
        length = self.length[at]
        return gather(self.pool, self.start[at], length), length

    def _add(self, n0: int, ids: np.ndarray, lens: np.ndarray) -> None:
        self.start, self.length = _room(self.start, n0 + len(lens)), _room(self.length, n0 + len(lens))
        self.pool = _room(self.pool, self.used + len(ids))
        self.start[n0:n0 + len(lens)] = self.used + np.cumsum(lens) - lens
        self.length[n0:n0 + len(lens)] = lens
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and their lengths."""
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out
