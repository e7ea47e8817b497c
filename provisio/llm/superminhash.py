r"""Near copies by SuperMinHash (operator 7).

A text's words (A-Z lower-cased) give its set of distinct 5-word shingles.  Texts with equal sets are one node.  Each
element of a set is assigned one position of a running random permutation per round and offers that slot its round number
plus a uniform fraction; a slot keeps the least offer, and a set is done once every slot holds less than the next round
number.  Signatures of SLOTS values are banded (ROWS values each); members of a band's bucket are held against each other
by their signatures, which gives candidate groups; inside these, links are confirmed on the full sets.  Linked nodes are
joined by a distributed union (see grouping).

A link needs 100 * |both| >= percent * |either|.  Bands have as many rows as leave a pair at that very likeness a chance
below MISS to share none (85 %: 32 bands of 8 rows), and signatures are only set aside when they agree in so few slots
that the likeness would have to be six standard deviations off.

Defined cases: a text with fewer than five words has one shingle, the whole sequence; a null, empty or wordless text has
an empty set and is linked with nothing; a null id never is a component's id unless all its ids are null; rows with the
same id are both kept if that id is its component's smallest; an empty table gives an empty result; other columns play no
part.  Copies of a text are counted, never paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh_name, slices, stored
from .grouping import components, linked, star_labels
from .textvec import LOWER, U, Spans, mix, words

SHINGLE, SLOTS, MISS = 5, 256, 1e-4
#: Rows of a group in one task: signatures take 256 bytes each, sets some kilobytes.
SIGNATURE_CHUNK, SET_CHUNK = 4096, 1024
#: Elements whose permutations are held at once, 256 bytes each.
BLOCK = 1 << 16


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = LOWER[buf]
    start, end, doc = words(buf, offs)
    h = Spans(buf).hash(start, end)
    n = len(h) - SHINGLE + 1
    key = np.zeros(max(0, n), U)
    for j in range(SHINGLE if n > 0 else 0):
        key = key * U(0x2545F4914F6CDD1D) + h[j:n + j]
    key = mix(key)
    at = np.searchsorted(doc, np.arange(len(offs)))
    out = []
    for lo, hi in zip(at.tolist(), at[1:].tolist(), strict=False):
        if hi - lo >= SHINGLE:
            out.append(np.unique(key[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            whole = U(hi - lo)
            for x in h[lo:hi]:
                whole = mix(np.array([whole ^ x], U))[0]
            out.append(np.array([whole], U))
        else:
            out.append(np.zeros(0, U))
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set; an empty set keeps `slots` everywhere.  Elements are worked off in blocks, so
    a set of any size takes as much memory as a block; what earlier blocks have found lets later ones stop sooner."""
    n_sets = len(sets)
    best = np.full(n_sets * slots, float(slots))
    item = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(n_sets), [len(s) for s in sets])
    for lo in range(0, len(item), BLOCK):  # a slot's minimum over all is that over the blocks
        part, own = item[lo:lo + BLOCK], owner[lo:lo + BLOCK]
        order = np.tile(np.arange(slots, dtype=np.uint16 if slots > 256 else np.uint8), (len(part), 1))
        live = np.arange(len(part))
        for j in range(slots):
            open_sets = best.reshape(n_sets, slots).max(axis=1) >= j
            live = live[open_sets[own[live]]]
            if not len(live):
                break
            draw = mix(part[live] + U((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            at = (j + ((mix(draw) >> U(32)) * U(slots - j) >> U(32))).astype(np.int64)
            slot = order[live, at]
            order[live, at] = order[live, j]
            np.minimum.at(best, own[live] * slots + slot, j + (draw >> U(11)).astype(np.float64) * 2.0 ** -53)
    return best.reshape(n_sets, slots)


def set_keys(sets: list[np.ndarray]) -> list[bytes]:
    """16 bytes that equal sets share: two sums of differently mixed elements."""
    total = lambda s, salt: int(np.sum(mix(s ^ U(salt)), dtype=U))
    return [(total(s, 0x5851F42D4C957F2D) ^ len(s)).to_bytes(8, "big") + total(s, 0x14057B7EF767814F).to_bytes(8, "big") for s in sets]


def band_rows(percent: int) -> int:
    """The most rows a band may have."""
    s = percent / 100
    return max(r for r in range(1, 33) if r == 1 or (1 - s ** r) ** (SLOTS // r) <= MISS)


def signature_likeness(percent: int):
    s = percent / 100
    least = int(SLOTS * (s - 6 * (s * (1 - s) / SLOTS) ** 0.5))

    def measure(payloads: list[bytes]):
        m = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), SLOTS)
        return lambda i, rows: np.count_nonzero(m[rows] == m[i], axis=1) >= least

    return measure


def set_link(percent: int):
    def measure(payloads: list[bytes]):
        sets = [np.frombuffer(p, "<u8") for p in payloads]
        size = np.array([len(s) for s in sets])

        def similar(i: int, rows: np.ndarray) -> np.ndarray:
            a = sets[i]
            near = (100 * np.minimum(size[rows], len(a)) >= percent * np.maximum(size[rows], len(a)))
            out = np.zeros(len(rows), bool)
            for lo in range(0, len(near), 256):
                some = np.flatnonzero(near[lo:lo + 256]) + lo
                if not len(some):
                    continue
                flat_sets = np.concatenate([sets[r] for r in rows[some]])
                at = np.minimum(np.searchsorted(a, flat_sets), len(a) - 1)
                ends = np.cumsum(size[rows[some]])
                run = np.concatenate([[0], np.cumsum(a[at] == flat_sets)])
                both = run[ends] - run[ends - size[rows[some]]]
                out[some] = 100 * both >= percent * (len(a) + size[rows[some]] - both)
            return out

        return similar

    return measure


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, doc_id, text, percent).select(doc_id, "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, node, label of its component (null without words), component_id, kept."""
    body = fresh_name([doc_id], "body")
    kind = docs.schema[doc_id].dataType
    source = docs.select(doc_id, F.col(text).alias(body))
    rows_each = band_rows(percent)
    n_bands = SLOTS // rows_each

    def sign(batches):
        for batch in batches:
            for part in slices(batch, body, 1 << 19):
                sets = shingle_sets(*flat(part.column(1)))
                best = mix(signatures(sets).view(U))
                bands = best[:, :n_bands * rows_each].reshape(len(sets), n_bands, rows_each)
                key = np.zeros(bands.shape[:2], U) + np.arange(n_bands, dtype=U) * U(0xD1342543DE82EF95)
                for r in range(rows_each):
                    key = mix(key ^ bands[:, :, r])
                low = (best & U(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_keys(sets), pa.binary()),
                     pa.array([r.tobytes() for r in low], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
                    names=[doc_id, "n_shingles", "node", "signature", "bands"])

    schema = f"`{doc_id}` {kind.simpleString()}, n_shingles long, node binary, signature binary, bands array<long>"
    signed = stored(source.mapInArrow(sign, schema), "signatures")
    full = signed.where("n_shingles > 0")

    # buckets of more than one node, each set of members once
    node = stored(full.groupBy("node").agg(F.first("signature").alias("payload"), F.first("bands").alias("bands"), F.min(doc_id).alias("least")), "nodes")
    member = node.select("node", F.explode("bands").alias("grp"))
    bucket = (member.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("y"))
              .where("n > 1").groupBy("n", "x", "y").agg(F.min("grp").alias("grp")).select("grp"))
    rows = stored(member.join(bucket, "grp", "left_semi").join(node.select("node", "payload"), "node"), "buckets")
    small, large = linked(rows, signature_likeness(percent), SIGNATURE_CHUNK)
    candidate = components(small if large is None else small.unionByName(large))

    # one row of each candidate node brings its text back for the full set
    first = candidate.join(node, "node").select("node", F.col("least").alias(doc_id), F.col("label").alias("grp"))

    def resolve(batches):
        for batch in batches:
            for part in slices(batch, body, 1 << 20):
                sets = shingle_sets(*flat(part.column(part.schema.get_field_index(body))))
                own = [part.column(part.schema.get_field_index(c)) for c in ("grp", "node")]
                keys = set_keys(sets)
                keep = [k == n for k, n in zip(keys, own[1].to_pylist(), strict=True)]  # rows that share an id may have other texts
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["grp", "node", "payload"]).filter(pa.array(keep))

    texts = source.join(first, source[doc_id].eqNullSafe(first[doc_id])).select("grp", "node", body)
    sets = stored(texts.mapInArrow(resolve, "grp binary, node binary, payload binary").dropDuplicates(["node"]), "sets")
    small, large = linked(sets, set_link(percent), SET_CHUNK)  # every node is in one group
    label = star_labels(small) if large is None else star_labels(small).unionByName(components(large))

    nodes = node.select("node", "least").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component"))
    of_node = nodes.join(least, "label").select("node", "label", "component")
    found = signed.select(doc_id, "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col(doc_id))
    return found.select(doc_id, "n_shingles", "node", "label", component.alias("component_id"), F.col(doc_id).eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, unique_ids: bool = True) -> DataFrame:
    """The rows of `docs` less all but one of each group of near copies: of the rows with the group's smallest id, those of
    its first set, and of these the one with the least row hash.  Rows without a word all stay.  `unique_ids`: of what
    stays, one row of each id."""
    node, at = fresh_name(docs.columns, "node"), fresh_name(docs.columns, "at")
    row_key = lambda n: F.concat(F.col(n), F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")).cast("binary"))
    kept = (_grouped(docs, doc_id, text, percent).where("kept AND n_shingles > 0").groupBy("label").agg(F.min(doc_id).alias(doc_id), F.min("node").alias(node))
            .select(row_key(node).alias(at)))

    def add_node(batches):
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                keys = set_keys(shingle_sets(*flat(part.column(part.schema.get_field_index(text)))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=[*part.schema.names, node])

    has_words = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    schema = docs.withColumn(node, F.lit(b"")).schema
    known = docs.where(has_words).mapInArrow(add_node, schema).select(*docs.columns, row_key(node).alias(at))
    # a shuffle for the join serves the grouping too
    row_hash = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    first = known.join(kept, at, "left_semi").groupBy(at).agg(F.min_by(F.struct(*docs.columns), row_hash).alias("row")).select("row.*")
    stay = first.unionByName(docs.where(~has_words))
    if not unique_ids:
        return stay
    return stay.where(F.col(doc_id).isNull()).unionByName(stay.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
