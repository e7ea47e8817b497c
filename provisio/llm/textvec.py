"""Vectorised text work over the flat UTF-8 bytes of many documents: words, lines and 64-bit hashes of spans.

Words are maximal runs without the ASCII white space x20, x09-x0D; in UTF-8 these bytes never occur inside another
character, so bytes suffice.  Equal spans get equal hashes wherever they stand.  Short spans are mixed eight bytes at a
time; long ones are polynomials modulo a prime, taken from prefix sums (modulo a power of two, some regular texts would
collide whatever the base).  Where a result must be exact, spans that meet by their hash are compared byte by byte.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Spans of up to so many bytes are hashed by eight bytes at a time.
SHORT = 64
#: Longer ones as polynomials modulo a prime, of blocks of so many bytes.
PRIME = (1 << 61) - 1
BASE = 0x0B4F2C7D19E3A865
BLOCK = 1 << 16
EIGHT = np.array([(1 << 8 * r) - 1 for r in range(9)], U)
M30, M31 = U((1 << 30) - 1), U((1 << 31) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & M31, b >> U(31), b & M31
    mid = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U(1)) + (mid >> U(30)) + ((mid & M30) << U(31)) + a0 * b0)


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo the prime, i < n."""
    out, x = np.empty(n, U), 1
    for i in range(n):
        out[i] = x
        x = x * base % PRIME
    return out


class Spans:
    """64-bit hashes of spans [start, end) of one flat buffer."""

    def __init__(self, buf: np.ndarray):
        self.buf = buf
        self.by_eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
        self.blocks = None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U) * U(0xA0761D6478BD642F))
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        at, left = start[live], size[live]
        while len(live):
            out[live] = mix(out[live] + (self.by_eight[at] & EIGHT[np.minimum(left, 8)]) * U(0x9E3779B97F4A7C15))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        long = np.flatnonzero(size > SHORT)
        if len(long):
            out[long] = mix(out[long] + self._polynomial(start[long], end[long]))
        return out

    def _polynomial(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal spans get equal values wherever they stand: the difference of two prefixes, brought back to its start."""
        if self.blocks is None:
            n = max(1, -(-len(self.buf) // BLOCK))
            code = np.zeros(n * BLOCK, U)
            code[:len(self.buf)] = self.buf
            code[:len(self.buf)] += U(1)
            code, power = code.reshape(n, BLOCK), powers(BASE, BLOCK)
            # sums of halves within a block: 9 + 31 + 16 bits at most
            self.high, self.low = np.cumsum(code * (power >> U(31)), axis=1), np.cumsum(code * (power & M31), axis=1)
            step, back = pow(BASE, BLOCK, PRIME), pow(BASE, -1, PRIME)
            self.up, self.down = powers(step, 1 << (n + 1).bit_length()), powers(pow(back, BLOCK, PRIME), 1 << (n + 1).bit_length())
            self.down_in = powers(back, BLOCK)
            whole, run = times(self.up[:n], self._joined(self.high[:, -1], self.low[:, -1])).tolist(), 0
            self.blocks = np.zeros(n + 1, U)
            for i, x in enumerate(whole):
                run = (run + x) % PRIME
                self.blocks[i + 1] = run
        span = reduced(self._prefix(end) + U(PRIME) - self._prefix(start))
        return times(times(span, self.down[start >> 16]), self.down_in[start & 0xFFFF])

    @staticmethod
    def _joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return reduced((high >> U(30)) + ((high & M30) << U(31)) + low)

    def _prefix(self, at: np.ndarray) -> np.ndarray:
        block, inside = at >> 16, at & 0xFFFF
        row, col = np.minimum(block, len(self.high) - 1), np.maximum(inside - 1, 0)
        part = np.where(inside > 0, self._joined(self.high[row, col], self.low[row, col]), U(0))
        return reduced(self.blocks[block] + times(self.up[block], part))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of two spans of one size are the same."""
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a != b) & (size > 0) & (size <= SHORT))
        x, y, left = a[live], b[live], size[live]
        while len(live):
            same = ((self.by_eight[x] ^ self.by_eight[y]) & EIGHT[np.minimum(left, 8)]) == 0
            out[live[~same]] = False
            more = same & (left > 8)
            live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
        for i in np.flatnonzero((a != b) & (size > SHORT)).tolist():
            out[i] = np.array_equal(self.buf[a[i]:a[i] + size[i]], self.buf[b[i]:b[i] + size[i]])
        return out


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans with the same bytes: the first of each kind, and the kind of each span.  Spans meet by their hashes, and what
    meets is compared byte by byte; spans whose hash is another's get a kind of their own."""
    spans, size = Spans(buf), end - start
    _, first, kind = np.unique(spans.hash(start, end), return_index=True, return_inverse=True)
    as_first = first[kind]
    other = np.flatnonzero((size != size[as_first]) | ~spans.equal(start, start[as_first], np.minimum(size, size[as_first])))
    if len(other):
        seen: dict[bytes, int] = {}
        more = []
        for i in other.tolist():
            own = buf[start[i]:end[i]].tobytes()
            if own not in seen:
                seen[own] = len(first) + len(seen)
                more.append(i)
            kind[i] = seen[own]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return first, kind


def first_of_each(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of small codes (below n): where each that occurs does so first, and the number of its kind for each place."""
    first = np.full(n, -1)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    used = first >= 0
    return first[used], (np.cumsum(used) - 1)[code]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each word, in order."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    sp = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    before[1:] = sp[:-1]
    start = np.flatnonzero(~sp & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = sp[1:]
    end = np.flatnonzero(~sp & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end (without \n) and document number of each \n-split line, in order; an empty text has one empty line."""
    nl = np.flatnonzero(buf == 10)
    docs = np.arange(len(offs) - 1)
    start = np.concatenate([offs[:-1], nl + 1])
    doc = np.concatenate([docs, np.searchsorted(offs, nl, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    end[last] = offs[1:][doc[last]]
    return start, end, doc


def count_in(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each [start, end)."""
    run = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=run[1:])
    return run[end] - run[start]


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of each span, end to end."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return pool[np.repeat(start - at, length) + np.arange(total)]
