"""Quality scores from random-indexing word vectors and a two-layer network (operator 10).

Each word and each word shape has a random sparse sign vector that follows from its hash.  Over all documents, the vector
of a word (of a shape) is the sum of the index vectors of the words and shapes within REACH places of it.  A document is
the mean of its words' vectors and the mean of its shapes', each centred and of unit length, words weighted by rarity.  A
network with one hidden layer, fitted in numpy on a bounded sample of labelled documents, gives a log-odds, and a
temperature fitted on a part of the sample that the network hasn't seen makes it a probability.

Words share BUCKETS hash buckets, so the tables have a fixed size and can travel to every task; partial tables are summed
in two rounds of shuffles.  `max_labels` bounds the sample (drawn by hash; all labelled rows, if there are fewer).

Defined cases: null or empty texts have the zero vector and get the network's score for it; without learnable labels every
score is 0.5, with labels of one kind it is that kind's smoothed share; a document with several label rows counts their
mean, rounded up from a half; null ids are scored, never learned from; repeated rows are scored each; other columns play
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh_name, slices, stored
from .textvec import LOWER, U, Spans, mix, words

BUCKETS, DIM, NONZERO, REACH, BLOCKS = 8192, 64, 6, 2, 16
FAN_IN, DECAY = 64, 1e-4
MAX_LABELS = 20_000
#: Byte classes of shapes: letters (upper, lower and beyond ASCII), digits; other bytes stand for themselves.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[0x30:0x3A], CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:] = 0x30, 0x41, 0x61, 0x61


def index_vectors(n: int, seed: int) -> np.ndarray:
    """A sparse sign vector for each of n buckets."""
    draw = mix(np.arange(n * NONZERO, dtype=U) + U(seed << 32)).reshape(n, NONZERO)
    out = np.zeros((n, DIM), np.int8)
    np.add.at(out, (np.arange(n)[:, None], (draw % U(DIM)).astype(np.int64)), np.where(draw >> U(63), 1, -1))
    return out


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape bucket and document number of each word."""
    start, end, doc = words(buf, offs)
    word = (Spans(LOWER[buf]).hash(start, end) >> U(40)).astype(np.int64) % BUCKETS
    kind = CLASS[buf].astype(U) if len(buf) else np.zeros(1, U)
    at = lambda i: kind[np.clip(i, start, end - 1)]
    shape = mix(at(start) | at(start + 1) << U(8) | at(end - 2) << U(16) | at(end - 1) << U(24) | np.minimum(end - start, 4).astype(U) << U(32))
    return word, (shape >> U(40)).astype(np.int64) % BUCKETS, doc


class ContextSums:
    """Sums of the index vectors around each word bucket and each shape bucket, and the buckets' counts (last column)."""

    def __init__(self):
        self.index = index_vectors(BUCKETS, 1), index_vectors(BUCKETS, 2)
        self.sums = np.zeros((2, BUCKETS, DIM + 1), np.int64)

    def add(self, buf: np.ndarray, offs: np.ndarray) -> None:
        word, shape, doc = tokens(buf, offs)
        if not len(word):
            return
        # REACH empty rows around every document, so that neighbours are plain sums of shifted rows; entries of an index vector
        # are NONZERO at most, so eight bits hold the sum of a few
        place = np.arange(len(word)) + REACH * (1 + doc)
        own = np.zeros((len(word) + REACH * (int(doc[-1]) + 2), DIM), np.int8)
        own[place] = self.index[0][word] + self.index[1][shape]
        near = np.zeros_like(own)
        for k in range(1, REACH + 1):
            near[k:] += own[:-k]
            near[:-k] += own[k:]
        for table, bucket in zip(self.sums, (word, shape), strict=True):
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            at = bucket[order][first]
            table[at, :DIM] += np.add.reduceat(near[place[order]], first, dtype=np.int32)
            table[at, DIM] += np.diff(first, append=len(order))


def context_sums(texts: DataFrame) -> np.ndarray:
    """The sums over all rows of a frame with one text column."""
    def count(batches):
        own = ContextSums()
        for batch in batches:
            for part in slices(batch, batch.schema.names[0], 1 << 20):
                own.add(*flat(part.column(0)))
        flat_sums = own.sums.reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId() // FAN_IN] * BLOCKS, pa.int32()),
                                          pa.array([x.astype("<i8").tobytes() for x in flat_sums], pa.binary())], names=["block", "part", "sums"])

    def total(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([own[0]], pa.int32()), pa.array([own[1] // FAN_IN], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["block", "part", "sums"])

        own, whole = None, np.zeros(0)
        for batch in batches:
            for key, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                if key != own:
                    if own is not None:
                        yield row()
                    own, whole = key, 0
                whole = whole + np.frombuffer(x.as_buffer(), "<i8")
        if own is not None:
            yield row()

    schema = "block int, part int, sums binary"
    parts = texts.mapInArrow(count, schema)
    for keys in (["block", "part"], ["block", "part"], ["block"]):  # sums of FAN_IN tasks, of FAN_IN of these, of what there is: 64 tasks or 200 000
        parts = parts.repartition(*keys).sortWithinPartitions("block", "part").mapInArrow(total, schema)
    whole = np.zeros((BLOCKS, 2 * BUCKETS * (DIM + 1) // BLOCKS), np.int64)
    for r in parts.collect():
        whole[r["block"]] += np.frombuffer(r["sums"], "<i8")
    return whole.reshape(2, BUCKETS, DIM + 1)


class DocumentVectors:
    """Pools the vectors of a document's words and shapes."""

    def __init__(self, sums: np.ndarray):
        self.table, self.weight = [], []
        for s in sums.astype(np.float64):
            n = s[:, DIM]
            v = s[:, :DIM] / np.maximum(n, 1)[:, None]
            v -= s[:, :DIM].sum(axis=0) / max(1.0, n.sum())
            v[n == 0] = 0
            self.weight.append(np.log1p(n.sum() / (1 + n)).astype(np.float32))
            self.table.append((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32) * self.weight[-1][:, None])
        self.size = 2 * DIM + 4

    def pool(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        out = np.zeros((n, self.size), np.float32)
        word, shape, doc = tokens(buf, offs)
        if not len(doc):
            return out
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        at, count = doc[first], np.bincount(doc, minlength=n).astype(np.float32)
        for k, bucket in enumerate((word, shape)):
            w = self.weight[k][bucket]
            total = np.add.reduceat(w, first)
            if k:  # a document has few shapes, each many times
                pair, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
                start = np.flatnonzero(np.diff(pair // BUCKETS, prepend=-1))
                v = self.table[k][pair % BUCKETS] * times[:, None].astype(np.float32)
            else:
                start, v = first, self.table[k][bucket]  # weighted already
            out[at, k * DIM:(k + 1) * DIM] = np.add.reduceat(v, start, axis=0) / total[:, None]
            out[:, 2 * DIM + k] = np.linalg.norm(out[:, k * DIM:(k + 1) * DIM], axis=1)
            if not k:  # how alike neighbours are
                alike = np.zeros(len(doc), np.float32)
                alike[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) / (w[1:] * w[:-1]) * (doc[1:] == doc[:-1])
                out[at, 2 * DIM + 2] = np.add.reduceat(alike, first) / count[at]
        out[:, 2 * DIM + 3] = np.log1p(count)
        return out


def gradients(w: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss and half DECAY times the squared weights, by both layers' weights and biases."""
    h = np.tanh(x @ w[0] + w[1])
    p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
    d = (p - y) / len(y)
    dh = np.outer(d, w[2]) * (1 - h * h)
    return [x.T @ dh + DECAY * w[0], dh.sum(axis=0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]


class Net:
    """Two layers and a temperature."""

    def __init__(self, constant: float = 0.5):
        self.constant = constant
        self.layers = None

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, hidden: int = 48, epochs: int = 40, seed: int = 1) -> Net:
        """held: rows kept for the temperature."""
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return self
        if not held.any() or held.all():
            held = np.zeros(len(y), bool)
        rng = np.random.default_rng(seed)
        own_x, own_y = x[~held].astype(np.float64), y[~held].astype(np.float64)
        self.mean, self.scale = own_x.mean(axis=0), own_x.std(axis=0) + 1e-6
        own_x = (own_x - self.mean) / self.scale
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(own_y))
            for lo in range(0, len(order), 256):
                rows = order[lo:lo + 256]
                grads = gradients(w, own_x[rows], own_y[rows])
                step += 1
                rate = 3e-3 * (1 - epoch / epochs)
                for a, g, ma, va in zip(w, grads, m, v, strict=True):
                    ma += 0.1 * (g - ma)
                    va += 0.001 * (g * g - va)
                    a -= rate * (ma / (1 - 0.9 ** step)) / (np.sqrt(va / (1 - 0.999 ** step)) + 1e-8)
        self.layers, self.temperature = w, 1.0
        if held.any():
            z, t = self.odds(x[held]), y[held]
            loss = lambda k: np.logaddexp(0, np.where(t > 0, -z, z) / k).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        w = self.layers
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.odds(x.astype(np.float64)) / self.temperature, -30, 30)))


def vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored doc_id and vector (little-endian 32-bit floats) of every row."""
    body = fresh_name([doc_id], "body")
    pooled = DocumentVectors(context_sums(docs.select(F.col(text).alias(body))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, body, 1 << 20):
                v = pooled.pool(*flat(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.astype("<f4").tobytes() for r in v], pa.binary())], names=[doc_id, "vector"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return stored(docs.select(doc_id, F.col(text).alias(body)).mapInArrow(run, f"`{doc_id}` {kind}, vector binary"), "document-vectors")


def learn(found: DataFrame, labels: DataFrame, learnable: Column, doc_id: str = "doc_id", label: str = "quality", max_labels: int = MAX_LABELS) -> Net:
    """A network from the vectors of labelled documents; learnable: which label rows may be used."""
    told = labels.where(learnable & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    n = told.count()
    share = F.lit(min(1.0, max_labels / max(1, n)) * (1 << 30))
    some = told.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < share)
    rows = found.join(some, doc_id).select(doc_id, "vector", "y", (F.pmod(F.xxhash64(doc_id, F.lit(5)), F.lit(5)) == 0).alias("held")).dropDuplicates([doc_id]).sort(doc_id).toArrow()
    if not rows.num_rows:
        return Net()
    x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), "<f4").reshape(rows.num_rows, -1)
    return Net().fit(x, rows.column("y").to_numpy(), np.array(rows.column("held").to_pylist()))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels that are not held out (crc32 of the id modulo 4 is not 2)."""
    fold = F.crc32(F.col(doc_id).cast("string")) % 4
    found = vectors(docs, doc_id, text)
    net = learn(found, labels, fold != 2, doc_id, label)

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(x))], names=[doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = found.mapInArrow(run, f"`{doc_id}` {kind}, score double")
    return scored.select(doc_id, F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
