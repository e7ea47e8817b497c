"""BPE encoding with forced boundaries, and decoding (operator 4).

A pair of neighbouring byte symbols that stands inside no vocabulary token can never be merged across, so it marks a
certain cut.  Words are cut there, the distinct fragments are merged independently of each other, all at once as rows of
an integer matrix (lowest merge rank first, as the tokenizers library does), and the ids are concatenated.

The vocabulary is a tokenizers file with a byte-level BPE with word ends: text in NFC, white space dropped, lower case.
White space never reaches a merge, so each distinct word of a batch is encoded once (chunks.ChunkPool).

Defined cases: null or empty text has no ids and decodes to the empty string; text of any length is taken whole; repeated
rows are encoded each; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import ChunkPool
from .common import flat, fresh_name, slices
from .textvec import distinct, first_of_each, gather, words

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's own split pattern, with line feeds as separators between the words given.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+|\n"
NONE = np.int64(1) << 40
#: Longer fragments (in bytes) are merged one by one.
LONG = 128


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others by
    the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class ForcedBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        symbols = byte_symbols()
        self.plain = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = np.array([vocab[a] * self.n_ids + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = np.append(key[order], NONE), np.append(order, NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # pairs of neighbours inside any token; 256 + byte is a byte that ends a word
        byte = {c: i for i, c in enumerate(symbols)}
        self.joined = np.zeros((256, 512), bool)
        for token in vocab:
            last = token.endswith(end) and token != end
            own = [byte[c] for c in (token[:-len(end)] if last else token) if c in byte]
            if last:
                own[-1] += 256
            for a, b in zip(own, own[1:], strict=False):
                self.joined[a, b] = True
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        shown = [names.get(i, "").encode() + b" " for i in range(self.n_ids)]
        self.token_len = np.array([len(t) for t in shown], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(PIECES)
        self.by_pair: dict[int, int] = {}
        self.pool = ChunkPool(self.encode_words)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        start, end, doc = words(buf, offs)
        ids, length = self.pool.ids(buf, start, end)
        return ids, np.concatenate([[0], np.cumsum(np.bincount(doc, length, len(offs) - 1))]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens' strings with spaces between."""
        ids = ids.astype(np.int64)
        return gather(self.token_bytes, self.token_at[ids], self.token_len[ids])[:-1].tobytes()

    def encode_words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of raw text (no ASCII white space in them) end to end, and how many each has."""
        texts = [c.decode() for c in chunks]
        odd = [i for i, t in enumerate(texts) if "<|" in t and self.marks and self.marks.search(t)]
        plain = [t.lower() if t.isascii() else self.normalizer.normalize_str(t) for t in texts]
        if not odd:
            return self.encode_pieces(plain)
        ids, length = self.encode_pieces(plain)
        each = np.split(ids, np.cumsum(length)[:-1])
        for i in odd:  # words with marks of the vocabulary: the marks are ids of their own, case and all
            parts = self.marks.split(texts[i])
            each[i] = np.concatenate([np.array([self.special[p]], np.uint32) if k % 2 else self.encode_pieces([self.normalizer.normalize_str(p)])[0] for k, p in enumerate(parts)])
        return np.concatenate(each), np.array([len(x) for x in each])

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts without line feeds, end to end, and how many each has."""
        found = self.split.findall("\n".join(texts))
        is_end = np.fromiter((p == "\n" for p in found), bool, len(found))
        owner = np.cumsum(is_end)[~is_end]
        pieces = [p.encode() for p in found if p != "\n"]
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.zeros(len(buf), bool)
        last[ends - 1] = True
        cut = np.ones(len(buf), bool)  # a fragment starts here
        cut[1:] = last[:-1] | ~self.joined[buf[:-1], buf[1:].astype(np.int64) + 256 * last[1:]]
        f_start = np.flatnonzero(cut)
        f_end = np.append(f_start[1:], len(buf))
        # a fragment is its bytes and whether it ends its word
        kinds, kind = distinct(buf, f_start, f_end)
        first, inverse = first_of_each(2 * kind + last[f_end - 1], 2 * len(kinds))
        ids, length = self.merge(np.where(last, self.final[buf], self.plain[buf]), f_start[first], f_end[first])
        start = np.cumsum(length) - length
        word = owner[np.searchsorted(ends, f_start, "right")]
        per_word = np.bincount(word, length[inverse], len(texts)).astype(np.int64)
        return gather(ids, start[inverse], length[inverse]).astype(np.uint32), per_word

    def merge(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each span of symbols by itself: ids end to end, and each span's number of ids."""
        size = end - start
        length = np.ones(len(size), np.int64)
        done_rows, done_at = [], []
        low = 1
        for i in np.flatnonzero(size > LONG):
            one = self.merge_long(symbols[start[i]:end[i]].tolist())
            length[i] = len(one)
            done_rows.append(np.array(one, np.int64))
            done_at.append(np.full(len(one), i))
        for high in (1, 4, 8, 16, 32, 64, LONG):  # spans of like length share a matrix
            at = np.flatnonzero((size >= low) & (size <= high))
            low = high + 1
            # a matrix has some four million cells at most
            step = max(1, (1 << 22) // max(1, int(size[at].max(initial=1))))
            for k in range(0, len(at), step):
                rows = at[k:k + step]
                m, n = self.merge_rows(symbols, start[rows], size[rows])
                length[rows] = n
                keep = np.arange(m.shape[1]) < n[:, None]
                done_rows.append(m[keep])
                done_at.append(np.repeat(rows, n))
        ids, at = np.concatenate(done_rows), np.concatenate(done_at)
        return ids[np.argsort(at, kind="stable")], length

    def merge_long(self, ids: list[int]) -> list[int]:
        """One long span, with a heap of its pairs and links between live positions."""
        if not self.by_pair:
            self.by_pair.update(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pair = lambda i: self.by_pair.get(ids[i] * self.n_ids + ids[after[i]], -1) if after[i] >= 0 else -1
        heap = [(r, i) for i in range(n) if (r := pair(i)) >= 0]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            r, i = heapq.heappop(heap)
            if not live[i] or pair(i) != r:
                continue  # a neighbour has merged meanwhile
            gone = after[i]
            ids[i], live[gone] = int(self.merged[r]), False
            after[i] = after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) >= 0:
                    heapq.heappush(heap, (r, k))
        return [x for x, alive in zip(ids, live, strict=True) if alive]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of neighbours, NONE if they don't merge; a negative symbol is none."""
        key = a * self.n_ids + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_rows(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        col = np.arange(width)
        m = np.full((len(size), width + 1), -1, np.int64)
        inside = col < size[:, None]
        m[:, :width][inside] = symbols[(start[:, None] + col)[inside]]
        n = size.copy()
        if width == 1:
            return m, n
        ranks = self.rank(m[:, :-1], m[:, 1:])
        live = np.arange(len(size))
        while len(live):
            best = ranks[live].argmin(axis=1)
            rank = ranks[live, best]
            go = rank < NONE
            live, best, rank = live[go], best[go], rank[go]
            if not len(live):
                break
            # close the gap at best + 1 in both arrays
            left = np.where(col > best[:, None], np.minimum(col + 1, width), col)
            rows = np.take_along_axis(m[live], left, 1)
            own = np.take_along_axis(ranks[live], np.minimum(left, width - 1), 1)
            own[:, -1] = NONE
            row = np.arange(len(live))
            rows[row, best] = self.merged[rank]
            m[live, :width], m[live, width] = rows, -1
            m[live, n[live] - 1] = -1
            n[live] -= 1
            rows = m[live]
            own[row, best] = self.rank(rows[row, best], rows[row, best + 1])
            has = best > 0
            own[row[has], best[has] - 1] = self.rank(rows[row[has], best[has] - 1], rows[row[has], best[has]])
            ranks[live] = own
        return m, n


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (int array), and the decoded text.

    The arrays are as large as the texts; take `digests` for the sums alone."""
    return _map(docs, path, doc_id, text, True)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""
    return _map(docs, path, doc_id, text, False)


def _map(docs: DataFrame, path: str, doc_id: str, text: str, full: bool) -> DataFrame:
    body = fresh_name([doc_id], "body")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        bpe = ForcedBpe(path)
        for batch in batches:
            for part in slices(batch, body, 2 << 20):
                ids, at = bpe.encode(*flat(part.column(1)))
                own = [ids[at[i]:at[i + 1]] for i in range(part.num_rows)]
                back = map(bpe.decode, own)
                cols = [part.column(0), pa.array(np.diff(at), pa.int64())]
                if full:
                    cols += [pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())), pa.array([b.decode() for b in back], pa.string())]
                else:
                    cols += [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                             pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[doc_id, "n_tokens", *(["ids", "decoded"] if full else ["ids_sha256", "decoded_sha256"])])

    kinds = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return docs.select(doc_id, F.col(text).alias(body)).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, {kinds}")
