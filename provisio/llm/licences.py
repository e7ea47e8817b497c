r"""Licence scans by Dice coefficient over word bigrams (operator 9).

Text is normalised (A-Z in lower case; every ASCII character but letters and digits is white space).  A template is held
against runs of words: the Dice coefficient of the two bags of word bigrams, 2 * |both| / (|run| + |template|), must reach
`least`.  Runs begin and end at any word, so a notice is found inside a longer sentence and in text without line ends.
Bounds prune: a run's size must lie between least / (2 - least) and (2 - least) / least of the template's, and run and
template must share least / (2 - least) of the template's bigrams; none loses a match.  The best run begins and ends with a
bigram of the template, as others at its ends only lower the coefficient.

Licences are ranked by their best run of words.  A licence is told with a run of whole segments (cut at line ends and after
sentence marks before white space) where one reaches `least`, else with its best run of words; of equal runs the first,
then the shortest.

Defined cases: null or empty text, or one of a single word, has no licence; text of any length is read whole; repeated
rows are scanned each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh_name, slices
from .licence_texts import TEMPLATES
from .textvec import SPACE, U, Spans, mix, words

LEAST = 0.8
NORMAL = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    NORMAL[_lo:_hi] = np.arange(_lo, _hi)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".;:!?"]] = True
FOUND = "array<struct<licence:string,dice:double,start:long,n_chars:long>>"


def bigrams(buf: np.ndarray, offs: np.ndarray):
    """Start, end and document of each word, segment number of each word, and the bigram from each word to the next."""
    plain = NORMAL[buf]
    start, end, doc = words(plain, offs)
    h = Spans(plain).hash(start, end)
    key = mix(h[:-1] * U(0x2545F4914F6CDD1D) + h[1:]) if len(h) else h
    cut = buf == 10
    cut[:-1] |= STOP[buf[:-1]] & SPACE[buf[1:]]
    return start, end, doc, np.concatenate([[0], np.cumsum(cut)])[start], key


class Templates:
    def __init__(self, texts: dict[str, list[str]], least: float):
        self.least = least
        self.names, bags = [], []
        for name, forms in texts.items():
            for form in forms:
                raw = form.encode()
                self.names.append(name)
                bags.append(np.unique(bigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[4], return_counts=True))
        self.bags = [dict(zip(k.tolist(), n.tolist(), strict=True)) for k, n in bags]
        self.size = np.array([int(n.sum()) for _, n in bags])
        self.need = np.ceil(self.size * least / (2 - least) - 1e-9).astype(int)
        self.most = np.floor(self.size * (2 - least) / least + 1e-9).astype(int)
        pairs = np.concatenate([np.stack([k, np.full(len(k), i, U)], 1) for i, (k, _) in enumerate(bags)])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.keys, first, self.count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        self.first, self.owner = first, pairs[:, 1].astype(np.int64)

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
        """Per text: (licence, dice, first byte, end byte) of each licence, the closest first."""
        out: list[list] = [[] for _ in range(len(offs) - 1)]
        start, end, doc, segment, key = bigrams(buf, offs)
        if len(key) == 0:
            return out
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hits = np.flatnonzero((self.keys[at] == key) & (doc[1:] == doc[:-1]))
        if not len(hits):
            return out
        n = self.count[at[hits]]
        own = self.owner[np.repeat(self.first[at[hits]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        where = np.repeat(hits, n)
        pair = doc[where] * len(self.names) + own
        order = np.lexsort((where, pair))
        pair, where = pair[order], where[order]
        lo = np.flatnonzero(np.diff(pair, prepend=-1))
        hi = np.append(lo[1:], len(pair))
        some = hi - lo >= self.need[pair[lo] % len(self.names)]
        for lo, hi in zip(lo[some].tolist(), hi[some].tolist(), strict=True):
            d, t = divmod(int(pair[lo]), len(self.names))
            places = where[lo:hi]
            earlier = self.earlier(t, key[places])
            by_word = self.best_run(t, places, earlier, places, places + 2)
            if by_word is None:
                continue
            w0, w1 = np.searchsorted(doc, [d, d + 1])
            parts = segment[w0:w1]
            firsts = np.unique(np.searchsorted(parts, segment[places]) + w0)  # segments that have hits
            ends = np.unique(np.searchsorted(parts, segment[places + 1], "right") + w0)
            by_segment = self.best_run(t, places, earlier, firsts, ends)
            dice, a, b = by_segment or by_word
            out[d].append((self.names[t], by_word[0], by_segment is not None, dice, int(start[a] - offs[d]), int(end[b - 1] - offs[d])))
        return [_best_each(x) for x in out]

    def earlier(self, t: int, keys: np.ndarray) -> np.ndarray:
        """Per hit the number of the hit with the same bigram as many hits back as the template has it, -1 if there is
        none: in a run that begins after that one, the hit counts."""
        order = np.argsort(keys, kind="stable")
        same = keys[order]
        back = np.arange(len(keys)) - np.array([self.bags[t][k] for k in same.tolist()])
        out = np.full(len(keys), -1)
        out[order] = np.where((back >= 0) & (same[back] == same), order[back], -1)
        return out

    def best_run(self, t: int, hits: np.ndarray, earlier: np.ndarray, firsts: np.ndarray, ends: np.ndarray):
        """(dice, first word, end word) of the best run from one of `firsts` to one of `ends` (both ascending), or None."""
        size, need, most = int(self.size[t]), int(self.need[t]), int(self.most[t])
        i = np.searchsorted(hits, firsts)
        e = np.searchsorted(hits, firsts + most)
        # the most that a run from each first word shares: its hits in reach, less those beyond the template's count
        lo = np.searchsorted(e, np.arange(len(hits)), "right")
        hi = np.searchsorted(i, earlier, "right")
        over = (earlier >= 0) & (lo < hi)
        beyond = np.cumsum(np.bincount(lo[over], minlength=len(firsts) + 1) - np.bincount(hi[over], minlength=len(firsts) + 1))[:-1]
        both = e - i - beyond
        best = None
        for k in np.flatnonzero(both >= need).tolist():
            m, a = int(both[k]), int(firsts[k])
            if best is not None and 2 * min(m, size) / (m + size) <= best[0]:
                continue
            to = ends[np.searchsorted(ends, a + need + 1):np.searchsorted(ends, a + most + 1, "right")]
            if not len(to):
                continue
            shared = np.concatenate([[0], np.cumsum(earlier[i[k]:e[k]] < i[k])])
            dice = 2 * shared[np.searchsorted(hits, to - 1) - i[k]] / (to - a - 1 + size)
            j = int(np.argmax(dice))
            if dice[j] >= self.least and (best is None or dice[j] > best[0]):
                best = float(dice[j]), a, int(to[j])
        return best


def _best_each(found: list[tuple]) -> list[tuple]:
    """(licence, dice, first, end) of each licence, ranked by its best run of words."""
    told: dict[str, tuple] = {}
    rank: dict[str, float] = {}
    for name, by_word, whole, dice, a, b in found:
        rank[name] = max(by_word, rank.get(name, 0.0))
        told[name] = min((not whole, -dice, a, b), told.get(name, (2,)))
    return [(x, -told[x][1], *told[x][2:]) for x in sorted(told, key=lambda x: (-rank[x], told[x][1], x))]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, best_licence (null if none), best_dice, and found: each licence with its coefficient and the place
    of its run in code points, the closest first."""
    body = fresh_name([doc_id], "body")
    texts = templates or TEMPLATES
    kind = docs.schema[doc_id].dataType.simpleString()
    found_type = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("n_chars", pa.int64())]))

    def run(batches):
        known = Templates(texts, least)
        for batch in batches:
            for part in slices(batch, body, 1 << 20):
                buf, offs = flat(part.column(1))
                points = lambda d, a, b: int(np.count_nonzero((buf[offs[d] + a:offs[d] + b] & 0xC0) != 0x80))  # noqa: B023, E731
                rows = [[{"licence": x, "dice": c, "start": points(d, 0, a), "n_chars": points(d, a, b)} for x, c, a, b in own] for d, own in enumerate(known.scan(buf, offs))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0]["licence"] if r else None for r in rows], pa.string()),
                                                  pa.array([r[0]["dice"] if r else 0.0 for r in rows], pa.float64()), pa.array(rows, found_type)],
                                                 names=[doc_id, "best_licence", "best_dice", "found"])

    return docs.select(doc_id, F.col(text).alias(body)).mapInArrow(run, f"`{doc_id}` {kind}, best_licence string, best_dice double, found {FOUND}")
