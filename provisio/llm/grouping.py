"""Connected components of a similarity graph inside groups of rows, without all pairs and without a group in one task.

`linked` finds, for rows (grp, node, payload), edges that connect exactly what the similarity graph of each group
connects.  Groups of up to `chunk` rows are one local search: a breadth-first search that holds each reached row against
the rows not yet reached, so a dense group costs about one pass.  A larger group is dealt over chunks by hash of its
nodes; every chunk is searched by itself and held against some pivots of the group (rows drawn by hash), which ties the
chunks of a dense group together.  What is then still outside its group's largest component is held against all rows of
the group, block by block.  So the work of a dense group grows with its size, and no pair that could matter is left out.

`components` contracts runs of edges where they lie, then alternates large-star and small-star; every round is stored in
the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

EDGE = "a binary, b binary"
PIVOTS = 48
#: Edges that a task holds at once.
RUN = 200_000


def groups(batches, keys: list[str]):
    """Tables of equal keys from batches that are sorted by the keys."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        ids = list(zip(*cols, strict=True))
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and ids[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = ids[lo]
    if held:
        yield pa.Table.from_batches(held)


def search(n: int, similar: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning edges and component numbers of rows 0 .. n - 1; similar(i, rows) -> flags."""
    label, edges, rest = np.full(n, -1, np.int64), [], np.arange(n)
    while len(rest):
        todo = [int(rest[0])]
        label[rest[0]] = k = int(rest[0])
        rest = rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = similar(i, rest)
            for j in rest[hit].tolist():
                edges.append((i, j))
                todo.append(j)
            label[rest[hit]] = k
            rest = rest[~hit]
    return edges, label


def _edges(found: list[tuple], ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.binary()), pa.array([ids[j] for _, j in found], pa.binary())], names=["a", "b"])


def stars(n: int, edges: list[tuple[int, int]], ids: list[bytes]) -> list[tuple[int, int]]:
    """Edges from each component's smallest id to its other rows."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        i, j = find(i), find(j)
        if ids[i] > ids[j]:
            i, j = j, i
        root[j] = i
    return [(r, i) for i in range(n) if (r := find(i)) != i and ids[r] != ids[i]]


def linked(rows: DataFrame, measure: Callable[[list], Callable[[int, np.ndarray], np.ndarray]], chunk: int) -> tuple[DataFrame, DataFrame | None]:
    """Stored edges (a, b): those of groups that are one local search, as stars around each component's smallest node, and
    those of larger groups (None if there is no such group).  measure(payloads) -> similar(i, rows)."""
    large = stored(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > chunk)
                   .withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int")), "large-groups", narrow=True)
    spread = F.xxhash64("node")

    def local(batches):
        for t in groups(batches, ["grp", "chunk"]):
            ids, role = t.column("node").to_pylist(), np.array(t.column("role").to_pylist())
            similar = measure(t.column("payload").to_pylist())
            members, pivots = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            found, label = search(len(members), lambda i, rest, m=members, f=similar: f(int(m[i]), m[rest]))
            out = [(int(members[i]), int(members[j])) for i, j in found]
            for p in pivots.tolist():
                hit = np.flatnonzero(similar(p, members))
                _, first = np.unique(label[hit], return_index=True)
                out += [(p, int(members[h])) for h in hit[first]]
            if out := stars(len(ids), out, ids):
                yield _edges(out, ids)

    def dealt(df: DataFrame, keys: list[str], run) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, EDGE)

    cols = ["grp", "chunk", "role", "node", "payload"]
    none = large.isEmpty()
    small = rows if none else rows.join(large, "grp", "left_anti")
    small_edges = stored(dealt(small.withColumns({"chunk": F.lit(0), "role": F.lit(0)}).select(cols), ["grp", "chunk"], local), "edges")
    if none:
        return small_edges, None

    big = rows.join(large, "grp").withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    drawn = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("size")
    pivots = big.where(drawn).withColumn("chunk", every).withColumn("role", F.lit(1)).select(cols)
    first = stored(dealt(big.withColumn("role", F.lit(0)).select(cols).unionByName(pivots), ["grp", "chunk"], local), "edges")

    big = stored(big.join(components(first), "node", "left").withColumn("label", F.coalesce("label", "node")), "large-group-rows")
    count = big.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = count.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = stored(big.join(main, "grp").where("label <> main").drop("main"), "large-group-rest")
    if rest.isEmpty():
        return small_edges, first
    blocks = rest.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    left = rest.join(blocks, "grp").withColumn("block", block).withColumn("chunk", every).withColumn("role", F.lit(1))
    right = big.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(0))
    cols = ["grp", "chunk", "block", "role", "node", "label", "payload"]

    def against(batches):
        for t in groups(batches, ["grp", "chunk", "block"]):
            ids, role = t.column("node").to_pylist(), np.array(t.column("role").to_pylist())
            _, label = np.unique(np.array([x.hex() for x in t.column("label").to_pylist()]), return_inverse=True)
            similar = measure(t.column("payload").to_pylist())
            out, members = [], np.flatnonzero(role == 0)
            for p in np.flatnonzero(role == 1).tolist():
                other = members[label[members] != label[p]]
                hit = other[similar(p, other)] if len(other) else other
                _, at = np.unique(label[hit], return_index=True)
                out += [(p, int(h)) for h in hit[at]]
            if out:
                yield _edges(out, ids)

    more = dealt(left.select(cols).unionByName(right.select(cols)), ["grp", "chunk", "block"], against)
    return small_edges, stored(first.unionByName(more), "edges")


def star_labels(edges: DataFrame) -> DataFrame:
    """node, label of edges that are stars already, each node in one star."""
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, with the same components: runs of up to RUN rows of a task become stars around the smallest
    node of each of their components."""
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN:
                yield one(held)
                held, n = [], 0
        if held:
            yield one(held)

    def one(held):
        t = pa.Table.from_batches(held)
        names: dict[bytes, int] = {}
        pairs = [(names.setdefault(x, len(names)), names.setdefault(y, len(names))) for x, y in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)]
        ids = list(names)
        found = stars(len(ids), pairs, ids)
        return pa.RecordBatch.from_arrays([pa.array([ids[j] for _, j in found], pa.binary()), pa.array([ids[i] for i, _ in found], pa.binary())], names=["u", "v"])

    return edges.mapInArrow(run, "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of an edge."""
    now = stored(contract(edges.select("a", "b").where("a <> b")).distinct(), "stars", narrow=True)

    def star(e: DataFrame) -> DataFrame:
        # neighbours above u, and u itself, get u's least neighbour, then neighbours below u, and u itself, the least of
        # them.  Minima are taken before rows meet and written, so a node with very many neighbours is met in plain joins
        # alone, whose rows Spark deals over several tasks
        least_of = lambda t, name: stored(t.groupBy("u").agg(F.min("v").alias("m")), name, narrow=True)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        above = both.join(least_of(both, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        above = stored(above, "above", narrow=True)
        below = above.join(least_of(above, "least"), "u")
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        return below.select(pairs.alias("p")).select("p.u", "p.v").where("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        # every node hangs on one other, and that hangs on none
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    while not settled(now):
        now = stored(star(now), "stars", narrow=True)
    return star_labels(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
