r"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 11).

Sources in the order of their names (code points, null last) weigh `shares`, repeating, and share the size of the whole
table by these weights.  A target stops at `most` times its source's size; what is over goes to the other sources by their
weights, until none is above.  A source is taken in complete epochs first.  What is left of its target is sampled: every
document draws u from a hash of itself and gets the key -ln(u) / w with its quality weight w, so that sorting by the key
samples without replacement in proportion to the weights (the exponential form of u ** (1 / w)).  Documents are taken by
ascending key until the sizes before them fill the budget; the last is cut where the budget ends, so a source's taken
words are its target rounded down.

Sizes are words `[^\x20\x09-\x0D]+`.  The query's quality weight is 1 less four times the share of ASCII digits,
punctuation and symbols in the text without white space, 0.1 at least (`symbol_weight`); any positive column may be given.

The sort never holds a source in one task: the density of ln(key) is 1/e at most whatever the weights, so steps of ln(key)
of BUCKET_ROWS / rows hold no more than BUCKET_ROWS / e rows of a source in expectation.  Sizes are summed by step, by
blocks of steps and by source, and running sums are put together from these three levels.

Defined cases: a null or empty text has size 0 and nothing is taken of it; rows without a source are a source of their own,
the last; a source without words has target 0; a table without words has targets 0; equal rows have equal keys and stand
next to each other, so which of them is cut is all one; rows of one id with other texts draw on their own; an empty table
gives an empty result; columns that play no part may have any name.  Runs agree whatever the partitions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, slices, stored

BUCKET_ROWS = 2048
BLOCK = 1024
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = bytes([*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
CONTINUATION = bytes(range(0x80, 0xC0))


def n_words(data: bytes) -> int:
    return sum(len(piece.split()) for piece in pieces(data))


def symbol_weight(data: bytes) -> float:
    """1 less four times the share of digits, punctuation and symbols, 0.1 at least (1 for an empty text)."""
    solid, other = len(data.translate(None, SPACES + CONTINUATION)), len(data.translate(None, SPACES + CONTINUATION + SYMBOLS))
    return max(0.1, 1.0 - 4.0 * ((solid - other) / solid if solid else 0.0))


def uniform(doc_id: Column, digest: Column, seed: int) -> Column:
    """A number in (0, 1) from the row's id and its text's digest: the first 52 bits of a digest, and a half."""
    own = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest))
    return (F.conv(F.substring(own, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def measured(docs: DataFrame, doc_id: str, text: str, source: str, weight: Column | None) -> DataFrame:
    """Per row: id, source, name (the source, never null), size, digest of the text, weight."""
    given = weight is not None

    def measure(batches):
        for batch in batches:
            for some in slices(batch, "body", 1 << 21):
                texts = [t or b"" for t in some.column(4).cast(pa.binary()).to_pylist()]
                own = some.column(3) if given else pa.array([symbol_weight(t) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array([n_words(t) for t in texts], pa.int64()), pa.array([hashlib.md5(t).hexdigest() for t in texts]), own],
                    names=["id", "source", "name", "size", "digest", "weight"])

    of = F.col(source).cast("string")
    rows = docs.select(F.col(doc_id).alias("id"), of.alias("source"), F.coalesce(F.concat(F.lit("="), of), F.lit("")).alias("name"),
                       (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), F.col(text).cast("string").alias("body"))
    return rows.mapInArrow(measure, f"id {docs.schema[doc_id].dataType.simpleString()}, source string, name string, size long, digest string, weight double")


def ranked(names: DataFrame, column: str) -> DataFrame:
    """`names` with place, from 0 by `column`, nulls last.  Rows are dealt over ranges, written, and counted by range, so
    no task sees them all."""
    order = F.col(column).asc_nulls_last()
    dealt = stored(names.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("size")).select("range", before.alias("offset"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return dealt.withColumn("within", within).join(ranges, "range").select(*names.columns, (F.col("within") + F.col("offset")).alias("place"))


def targets(sources: DataFrame, shares: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """(name, source, source_size) with the target of each: shares of the whole, none above `most` times its source.

    Each round takes the shares of what the stopped sources leave, and stops the sources above their bound; a source that
    was stopped stays so.  A round is one sum over the sources; it ends when no further source stops."""
    share = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (F.col("place") % len(shares) + 1).cast("int"))
    known = stored(ranked(sources, "source").withColumn("share", share.cast("long")), "sources")
    bound, above, stopped = F.col("source_size") * most, F.lit(False), -1
    while True:
        told = known.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, bound)).alias("at_bound"),
                         F.sum(F.when(~above, F.col("share"))).alias("shares"), F.count(F.when(above, 1)).alias("n")).first()
        left, open_shares = (told["all"] or 0) - (told["at_bound"] or 0), told["shares"] or 0
        if told["n"] == stopped or not open_shares:
            break
        stopped, above = told["n"], F.col("share") * F.lit(left / open_shares) > bound
    each = max(open_shares, 1)
    fair = (F.col("share") * F.lit(left)).cast("double") / F.lit(float(each))
    return known.select("name", "source", "source_size", F.when(above, bound.cast("double")).otherwise(fair).alias("target"),
                        F.when(above, bound).otherwise(F.expr(f"(share * {left}L) div {each}L")).cast("long").alias("words"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
        shares: tuple = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, taken."""
    key = -F.log(uniform(F.col("id"), F.col("digest"), seed)) / F.col("weight")
    rows = measured(docs, doc_id, text, source, weight).select("id", "source", "name", "size", key.alias("key"))
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    of_source = stored(targets(sizes, shares, most), "mix-targets")
    total = rows.count()

    step = F.floor(F.log("key") * F.lit(max(1.0, total / BUCKET_ROWS))).cast("long").alias("step")
    dealt = rows.select("id", "name", "size", "key", step)
    steps = stored(dealt.groupBy("name", "step").agg(F.sum("size").alias("size")).withColumn("block", F.floor(F.col("step") / BLOCK)), "mix-steps")
    so_far = lambda *keys, by: F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = steps.groupBy("name", "block").agg(F.sum("size").alias("size")).withColumn("before_block", so_far("name", by="block")).drop("size")
    blocks = blocks.join(of_source, "name")
    steps = (steps.withColumn("before_step", so_far("name", "block", by="step")).drop("size").join(blocks, ["name", "block"])
             .select("name", "step", (F.col("before_step") + F.col("before_block")).alias("before"), "source", "source_size", "target", "words"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("name", "step").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("within", within).join(steps, ["name", "step"])
    epochs = F.expr("words div greatest(source_size, 1)")
    rest = F.expr("words % greatest(source_size, 1)")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("before") - F.col("within")))
    return placed.select(F.col("id").alias(doc_id), "size", "source", "source_size", "target", (F.col("size") * epochs + part).cast("long").alias("taken"))
