r"""Ranked lexical search turned round (operator 12): the queries are indexed, the documents are streamed.

The items' terms make an inverted index (term -> items and how often), which is broadcast.  Every document's terms are
counted once; what concerns the index is kept as a row of (id, length, terms, counts), and over these rows document
frequencies are summed.  A second pass streams the rows through the index: each document adds its scores to the items that
share a term with it, and each task holds, per item, the best `k` documents so far.  The tasks' lists are merged per item.

Terms are the maximal runs of ASCII letters, digits and any character beyond ASCII, A-Z lower-cased: in UTF-8 runs of the
bytes 0-9, A-Z, a-z and x80-xFF.  N documents have a term, L is all their terms, n one document's, df the documents with a
term, tf its count in the document: weight w = floor(1000 * ln((2N + 2) / (2df + 1))), measure m = 75 + (25 * n * N) div L,
and an item's score sums w * ((1000000000 * tf) div (1000 * tf + 12 * m)) over its terms with repeats.  Terms with w = 0
add nothing and are left out of the second pass.

What is broadcast is bounded: items are dealt by hash into as many blocks as keep each under BLOCK_BYTES of text (or one
longer item); every block is a pass over all documents.  Nothing of the documents reaches the driver but the frequencies
of the block's terms.

Defined cases: a null or empty text has no term, such a document isn't counted and such an item has no results; items
repeated in full are one item, rows that share an item id but not the text are items of their own; documents repeated in
full are ranked each, after one another; among equal scores a document without an id comes last; fewer than `k` documents
above 0 are all returned; empty tables give an empty result; columns that play no part may have any name.  Very long texts
are counted in pieces, so memory follows their distinct terms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, slices, stored

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of item texts in one broadcast index.
BLOCK_BYTES = 8 << 20
#: Document-item scores held at once.
SCORES = 1 << 22
NO_ID = (1 << 63) - 1


def terms_of(data: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    count = Counter()
    for piece in pieces(data, GAP):
        count.update(TERM.findall(piece.lower()))
    return count


class Index:
    """The inverted index of a block of items: of each term the items (numbers) that hold it, and how often."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        found = []
        for i, t in enumerate(texts):
            found += [(self.number.setdefault(term, len(self.number)), i, n) for term, n in terms_of(t).items()]
        table = np.array(sorted(found), np.int64).reshape(len(found), 3)
        self.n_items = len(texts)
        self.start = np.searchsorted(table[:, 0], np.arange(len(self.number) + 1))
        self.item, self.times = table[:, 1], table[:, 2]


class Heaps:
    """The best k documents of each item: scores descending, equal ones by ascending id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: one row per document."""
        at, item = np.nonzero((scores >= self.least) & (scores > 0))
        if not len(at):
            return
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[at, item[len(self.item):]]])
        doc = np.concatenate([self.doc, docs[at]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        keep = place < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    """The distinct items in blocks; each is read when its turn comes."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("body")).distinct()
    size = F.coalesce(F.octet_length("body"), F.lit(0)) + 16
    told = rows.agg(F.sum(size).alias("all"), F.max(size).alias("longest")).first()
    n = max(1, math.ceil((told["all"] or 0) / BLOCK_BYTES))
    while n > 1:
        block = F.pmod(F.xxhash64("item_id", "body"), F.lit(n))
        if rows.groupBy(block.alias("b")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] <= BLOCK_BYTES + told["longest"]:
            break
        n *= 2
    for b in range(n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == b).collect()


def postings(docs: DataFrame, doc_id: str, text: str, index) -> DataFrame:
    """(id, n, terms, counts) of every document with a term; only terms of the index are listed."""
    def count(batches):
        number = index.value.number
        for batch in batches:
            for some in slices(batch, "body", 1 << 21):
                rows = ([], [], [], [])
                for i, t in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = terms_of(t) if t else None
                    if found:
                        own = found.keys() & number.keys()
                        for to, x in zip(rows, (i, found.total(), [number[w] for w in own], [found[w] for w in own]), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int32())),
                                                  pa.array(rows[3], pa.list_(pa.int32()))], names=["id", "n", "terms", "counts"])

    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    return stored(own.mapInArrow(count, "id long, n long, terms array<int>, counts array<int>"), "postings")


def score_rows(index: Index, weight: np.ndarray, n: np.ndarray, lens: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of a few documents (rows) for all items, from their listed terms end to end."""
    m = 75 + 25 * n * n_docs // n_terms
    doc = np.repeat(np.arange(len(n)), lens)
    use = weight[term] > 0
    doc, term, tf = doc[use], term[use], tf[use].astype(np.int64)
    part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    held = index.start[term + 1] - index.start[term]
    at = np.repeat(index.start[term] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
    out = np.zeros(len(n) * index.n_items, np.int64)
    np.add.at(out, np.repeat(doc, held) * index.n_items + index.item[at], np.repeat(part, held) * index.times[at])
    return out.reshape(len(n), index.n_items)


def best_documents(rows: DataFrame, index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score): the best k of each task."""
    def stream(batches):
        own = index.value
        heaps = Heaps(own.n_items, k)
        step = max(1, SCORES // max(1, own.n_items))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                terms, tf = some.column(2), some.column(3)
                lens = np.diff(terms.offsets.to_numpy())
                docs = some.column(0).fill_null(NO_ID).to_numpy()
                heaps.offer(score_rows(own, weight, some.column(1).to_numpy(), lens, terms.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_terms), docs)
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(heaps.doc, mask=heaps.doc == NO_ID), pa.array(heaps.score)], names=["item", "doc", "score"])

    few = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)  # as many lists to merge as the cluster runs at once, not as there are files
    return few.mapInArrow(stream, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its `k` best documents: item_id, rank, doc_id, score."""
    spark, found = docs.sparkSession, None
    kind = items.schema[item_id].dataType.simpleString()
    for block in blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(Index([(r["body"] or "").encode() for r in block]))
        rows = postings(docs, doc_id, text, index)
        told = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(index.value.number), np.int64)
        for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * told["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = best_documents(rows, index, weight, told["docs"], told["terms"] or 1, k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kind}")
        best = best.withColumn("rank", place).where(F.col("rank") <= k).join(names, "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
        found = best if found is None else found.unionByName(best)
    return found
