r"""Filter interaction audit by a Gray-code subset walk (operator 13).

Every document is measured once and gets a mask with a bit for each filter it fails.  Documents are counted by part and
mask, which leaves at most 2**n cells of a part.  Over these cells a walk visits all subsets of the n filters in Gray-code
order, so that one filter is toggled at a time: each cell has a counter of the active filters it fails, and the running
survivors change only where a counter leaves or reaches zero.  The survivors of all subsets (32 states for five filters)
are kept, and every step of every order of the filters is the difference of two of them.

Words are maximal runs without x20, x09-x0D.  Filters, as what fails them: A under 200 words; B distinct words fewer than
half the words; C more than 3 of 100 code points in A-Z; D any of #$%&*|; E the text of a row with a smaller id.

Defined cases: a null text is the empty text (which fails A, and E if a smaller id has an empty text); a null part is the
empty string and counts with it; a row without an id neither is smaller than another nor has a smaller one, so it never
fails E; rows of one id and one text don't fail E for each other; a document counts as good or toxic if any label row of
its id says so, and rows without an id have no labels; a table without rows has no parts and gives no rows; columns that
play no part may have any name.  Very long texts are measured in pieces, so memory follows their distinct words.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, slices, stored

FILTERS = "ABCDE"
UPPER = bytes(range(0x41, 0x5B))
SYMBOLS = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Rows without an id are dealt over so many groups where they meet the labels (which they never match).
SALTS = 1024


def text_failures(data: bytes) -> int:
    """The bits of filters A to D that a UTF-8 text fails."""
    n_words, distinct = 0, set()
    for piece in pieces(data):
        found = piece.split()
        n_words += len(found)
        distinct.update(found)
    upper = len(data) - len(data.translate(None, UPPER))
    points = len(data.translate(None, CONTINUATION))
    return ((n_words < 200) | (100 * len(distinct) < 50 * n_words) << 1 | (100 * upper > 3 * points) << 2
            | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row: id, part, bits of A to D, digest of the text."""
    def measure(batches):
        for batch in batches:
            for some in slices(batch, "body", 1 << 21):
                texts = some.column(2).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([text_failures(t or b"") for t in texts], pa.int32()),
                     pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary())], names=["id", "part", "bits", "digest"])

    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("body"))
    return own.mapInArrow(measure, f"id {docs.schema[doc_id].dataType.simpleString()}, part string, bits int, digest binary")


def mask_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters.  Copies are counted before they meet, so a text
    that a third of the rows share is a few rows to every later step; nothing is grouped by text alone before that."""
    rows = measured(docs, doc_id, text, part).groupBy("digest", "part", "bits", "id").agg(F.count(F.lit(1)).alias("n"))
    told = labels.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    deal = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("deal", deal).join(told.withColumn("deal", F.lit(0).cast("long")), ["id", "deal"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    has_id = F.col("id").isNotNull()
    same = rows.select("digest", "part", "bits", "id", "n", flag("good"), flag("toxic")).groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("no_id"),
        F.min(F.when(has_id, F.struct("id", "n"))).alias("least"))
    same = stored(same, "audit-texts")
    first = same.groupBy(F.col("digest").alias("_digest")).agg(F.min("least.id").alias("first"))
    same = same.join(first, F.col("digest") == F.col("_digest"))
    passes = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    split = same.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("mask"), passes.alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - passes).alias("n")))).alias("c"))
    split = split.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    count = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def states(masks: list[int], counts: np.ndarray, n_filters: int) -> np.ndarray:
    """What survives each subset of the filters: a row of sums for each subset's bits."""
    out = np.zeros((1 << n_filters, counts.shape[1]), np.int64)
    active, fails, alive = 0, [0] * len(masks), counts.sum(axis=0)
    out[0] = alive
    for i in range(1, 1 << n_filters):
        bit = i & -i
        active ^= bit
        on = bool(active & bit)
        for c, mask in enumerate(masks):
            if mask & bit:
                fails[c] += 1 if on else -1
                if on and fails[c] == 1:
                    alive = alive - counts[c]
                elif not on and fails[c] == 0:
                    alive = alive + counts[c]
        out[active] = alive
    return out


def order_steps(left: np.ndarray, filters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders, from
    the survivors of all subsets (columns: documents, good, toxic)."""
    everything = len(left) - 1
    failing = [int(left[0, 0] - left[1 << f, 0]) for f in range(len(filters))]
    alone = [int(left[everything ^ 1 << f, 0] - left[everything, 0]) for f in range(len(filters))]
    rows, total = [], [0] * len(filters)
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[f] for f in order), 0
        for step, f in enumerate(order, start=1):
            after = before | 1 << f
            removed, good, toxic = (int(x) for x in left[before] - left[after])
            total[f] += removed
            rows.append((name, step, f, int(left[after, 0]), removed, failing[f] - removed, alone[f], good, toxic))
            before = after
    return [(name, step, *rest, total[f]) for name, step, f, *rest in rows]


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from cells (part, mask, n, good, toxic)."""
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def walk(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        left = states(own["mask"].tolist(), own[["n", "good", "toxic"]].to_numpy(np.int64), len(filters))
        out = pd.DataFrame(order_steps(left, filters), columns=names)
        out.insert(0, "part", key[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[2:])
    return cells.groupBy("part").applyInPandas(walk, schema)


def filter_interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over all orders, by part."""
    return audit(mask_cells(docs, labels, doc_id, text, part))
