"""Sum-of-squares online packing of tokenized documents (operator 3).

Each task reads its documents in order and keeps one level array: level h counts the open windows filled to h tokens.  A
document's whole windows leave at once; its rest goes to the fill level that leaves the smallest sum of squared counts
over the partly filled levels (ties: the fullest window).  When a task ends, or when more than MAX_OPEN windows are open,
the open windows are closed: the emptiest are cut up to fill the gaps of the fullest, and the one window left over is cut
into runs whose lengths are powers of two, which need no padding.  So nothing is padded, and state never exceeds
MAX_OPEN windows however the lengths are spread.

Defined cases: a null or empty text is one token (the end token); repeated rows are packed each; an empty table gives no
piece; other columns play no part.  A task's numbers start from its partition number, so a task that runs again after a
lost executor writes the same pieces.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .chunks import ChunkPool, joined
from .common import flat, fresh_name, slices
from .textvec import words

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MAX_OPEN = 2048
END_TEXT = b"<|endoftext|>"
#: White space outside ASCII in UTF-8; its texts go to the tokenizer whole.
WIDE_SPACE = [bytes([0xC2, 0x85]), bytes([0xC2, 0xA0])] + [chr(c).encode() for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


class ByteBpe:
    """Ids of whole texts under a byte-level BPE vocabulary, as the tokenizers library gives them.

    Chunks are words with one space before them and the white space between; the split pattern never joins or parts
    bytes across these cuts.  Texts with other white space or the end marker go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pool = ChunkPool(lambda chunks: joined([own.encode_ordinary(c.decode()) for c in chunks]))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and n + 1 offsets."""
        n_docs = len(offs) - 1
        start, end, doc = self.cut(buf, offs)
        ids, length = self.pool.ids(buf, start, end)
        per_doc = np.bincount(doc, length, n_docs).astype(np.int64)
        odd = self.odd(buf, offs)
        if not len(odd):
            return ids, np.concatenate([[0], np.cumsum(per_doc)])
        at = np.concatenate([[0], np.cumsum(per_doc)])
        parts = [ids[at[i]:at[i + 1]] for i in range(n_docs)]
        data = buf.tobytes()
        for i in odd:
            parts[i] = np.array(self.whole.encode(data[offs[i]:offs[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    @staticmethod
    def odd(buf: np.ndarray, offs: np.ndarray) -> list[int]:
        data, found = buf.tobytes(), set()
        for mark in (END_TEXT, *WIDE_SPACE):
            at = data.find(mark)
            while at >= 0:
                i = int(np.searchsorted(offs, at, "right")) - 1
                found.add(i)
                at = data.find(mark, int(offs[i + 1]))
        return sorted(found)

    @staticmethod
    def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, doc = words(buf, offs)
        n_docs = len(offs) - 1
        first = offs[doc]
        before = np.where(start > first, buf[np.maximum(start, 1) - 1], 0) if len(buf) else start
        head = start - (before == 0x20)
        # the gap before a word reaches back to the word before it or to its document's start
        g_from = np.concatenate([[0], end[:-1]])[:len(start)]
        g_from = np.maximum(g_from, first)
        whole_gap = start - g_from
        body_to = start - 1
        lone = (before != 0x20) & (whole_gap > 0)
        a = np.flatnonzero(whole_gap > 1)
        b = np.flatnonzero(lone)
        # white space at the end of a document, or a document of white space alone
        last_end = offs[:-1].copy()
        last_end[doc] = end  # the last write of a document stays
        t = np.flatnonzero(offs[1:] > last_end)
        s = np.concatenate([head, g_from[a], body_to[b], last_end[t]])
        e = np.concatenate([end, body_to[a], start[b], offs[1:][t]])
        d = np.concatenate([doc, doc[a], doc[b], np.arange(n_docs)[t]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order], d[order]


class Packer:
    """The level array of one task.  A piece is [document, start, ids, document's tokens]."""

    def __init__(self, size: int, first_id: int, max_open: int = MAX_OPEN):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.rows = 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        n, size = len(ids), self.size
        for at in range(0, n - size + 1, size):
            self.emit([[doc, at, ids[at:at + size], n]])
        s = n % size
        if s:
            piece = [doc, n - s, ids[n - s:], n]
            h = self.level(s)
            window = self.open[h].pop() if h else []
            if h:
                self.counts[h] -= 1
                self.n_open -= 1
            window.append(piece)
            if h + s == size:
                self.emit(window)
            else:
                self.open[h + s].append(window)
                self.counts[h + s] += 1
                self.n_open += 1
                if self.n_open > self.max_open:
                    self.close(final=False)

    def level(self, s: int) -> int:
        """The level to put s tokens on: least change of the sum of squares, halved and less 1/2."""
        c, last = self.counts, self.size - s
        change = (c[s:self.size] - c[:last] + 1).astype(np.float64)  # level h to h + s
        change[0] = c[s] + 0.5 - 0.5 * (s == self.size)
        change[1:][c[1:last] == 0] = np.inf
        change = np.append(change, 0.5 - c[last] if last and c[last] else np.inf)  # the window that s fills up
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def emit(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def close(self, final: bool = True) -> None:
        """Fill the gaps of the fullest open windows with what the emptiest hold."""
        todo = [w for level in reversed(self.open) for w in level]  # fullest first
        self.open = [[] for _ in range(self.size + 1)]
        self.counts[:] = 0
        self.n_open = 0
        lo, hi = 0, len(todo) - 1
        while lo < hi:
            window, gap = todo[lo], self.size - sum(len(p[2]) for p in todo[lo])
            while gap and hi > lo:
                doc, start, ids, total = todo[hi].pop()
                take = min(gap, len(ids))
                if take < len(ids):
                    todo[hi].append([doc, start + take, ids[take:], total])
                window.append([doc, start, ids[:take], total])
                gap -= take
                if not todo[hi]:
                    hi -= 1
            if gap:
                break
            self.emit(window)
            lo += 1
        if lo <= hi and todo and todo[lo]:
            fill = sum(len(p[2]) for p in todo[lo])
            if fill == self.size:
                self.emit(todo[lo])
            elif final:
                self.tail(todo[lo], fill)
            else:
                self.open[fill].append(todo[lo])
                self.counts[fill] += 1
                self.n_open = 1

    def tail(self, window: list, fill: int) -> None:
        power = 1 << (fill.bit_length() - 1)
        room, run = power, []
        for doc, start, ids, total in window:
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                run.append([doc, start + at, ids[at:at + take], total])
                at, room, fill = at + take, room - take, fill - take
                if not room:
                    self.emit(run)
                    run, room = [], 1 << max(0, fill.bit_length() - 1)


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    body = fresh_name([doc_id], "body")
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = SCHEMA.replace(" long", "").split(", ")

    def run(batches):
        bpe = ByteBpe(path)
        packer = Packer(size, TaskContext.get().partitionId() << 40)
        batch = None
        for batch in batches:
            for part in slices(batch, body, 2 << 20):
                ids, at = bpe.encode(*flat(part.column(1)))
                for i, d in enumerate(part.column(0).to_pylist()):
                    own = np.empty(at[i + 1] - at[i] + 1, np.uint32)
                    own[:-1], own[-1] = ids[at[i]:at[i + 1]], end_id
                    packer.add(d, own)
                yield from out(packer, batch)
        if batch is not None:
            packer.close()
            yield from out(packer, batch)

    def out(packer, batch):
        if packer.rows:
            cols = list(zip(*packer.rows, strict=True))
            packer.rows = []
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[doc_id, *fields])

    from pyspark.sql import functions as F
    return docs.select(doc_id, F.col(text).alias(body)).mapInArrow(run, f"`{doc_id}` {kind}, {SCHEMA}")
