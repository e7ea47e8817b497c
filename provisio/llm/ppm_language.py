"""Language identification by prediction with partial matching (operator 8).

Each language has a tree of byte contexts up to ORDER bytes long, with the counts of the bytes that followed.  A byte
costs -log2 of its frequency in the longest known context; where the byte is new there, the escape (method C: as many
counts as the context has seen different bytes) is paid and the next shorter context is asked, down to 1/256.  The counts
are frozen after learning, so a text's code length under each language is a sum over its bytes; the shortest wins.  The
score is the winner's share when the whole text is given the weight of EVIDENCE bytes.

Learning takes about `max_docs` documents of each language, drawn by hash (all, if there are fewer); the driver gets the
distinct (ORDER + 1)-grams of that sample, never texts.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text if nothing could be learned;
rows with a null id or language are not learned from, and a null id counts as not held out; repeated rows are judged each;
other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, fresh_name, slices

ORDER, EVIDENCE, MAX_DOCS = 3, 64, 1500
START = 10  # the byte before a text


def grams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The code of each byte behind the ORDER bytes before it; each text begins anew."""
    out = buf.astype(np.uint64)
    before = np.concatenate([np.full(ORDER, START, np.uint8), buf])
    pos = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    for k in range(1, ORDER + 1):
        b = before[ORDER - k:ORDER - k + len(buf)].astype(np.uint64)
        b[pos < k] = START
        out |= b << np.uint64(8 * k)
    return out


class ContextTrees:
    """Frozen statistics of all languages; codes and counts: per language, its distinct grams."""

    def __init__(self, names: list[str], codes: list[np.ndarray], counts: list[np.ndarray]):
        self.names, self.levels = names, []
        for c, n in zip(codes, counts, strict=True):
            own = []
            for k in range(ORDER, -1, -1):  # context length
                code = c & np.uint64((1 << 8 * (k + 1)) - 1)
                keys, inverse = np.unique(code, return_inverse=True)
                count = np.bincount(inverse, n, len(keys))
                ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                own.append((keys, count, ctx, np.bincount(at, count), np.bincount(at).astype(float)))
            self.levels.append(own)
        self.known = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        self.cost = self.lengths(self.known)

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Code length in bits of each gram's last byte, by language."""
        out = np.zeros((len(codes), len(self.names)), np.float32)
        for i, levels in enumerate(self.levels):
            bits, todo = np.zeros(len(codes)), np.arange(len(codes))
            for k, (keys, count, ctx, total, distinct) in zip(range(ORDER, -1, -1), levels, strict=True):
                code = codes[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(ctx, code >> np.uint64(8)), len(ctx) - 1)
                seen = ctx[at] == code >> np.uint64(8)
                sym = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = keys[sym] == code
                whole = total[at] + distinct[at]
                bits[todo[hit]] -= np.log2(count[sym[hit]] / whole[hit])
                miss = seen & ~hit
                bits[todo[miss]] -= np.log2(distinct[at[miss]] / whole[miss])
                todo = todo[~hit]
            bits[todo] += 8
            out[:, i] = bits
        return out

    def text_bits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each whole text, by language."""
        sums = np.zeros((len(offs) - 1, len(self.names)))
        if not len(buf):
            return sums
        codes, inverse = np.unique(grams(buf, offs), return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        cost = self.cost[at]
        new = self.known[at] != codes
        cost[new] = self.lengths(codes[new])
        full = np.flatnonzero(np.diff(offs) > 0)
        for i in range(len(self.names)):
            sums[full, i] = np.add.reduceat(cost[:, i][inverse].astype(np.float64), offs[:-1][full])
        return sums


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = buf | 0x20
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A) & (buf < 0x80))])
    out = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, buf[offs[i]:offs[i + 1]].tobytes().decode()))
    return out


def learn(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> ContextTrees:
    """Count the grams of a bounded sample of the learnable texts of each language.  Texts are drawn by a hash of themselves
    and copies count once, so the same rows teach the same trees however they lie in files."""
    rows = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("body"), F.xxhash64(text).alias("own"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", "own").distinct().groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(max_docs / n)).otherwise(share)
    draw = F.pmod("own", F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                names = np.array(part.column(0).to_pylist(), object)
                buf, offs = flat(part.column(1))
                code = grams(buf, offs)
                owner = np.repeat(names, np.diff(offs))
                for name in set(names.tolist()):
                    held.setdefault(name, []).append(np.unique(code[owner == name], return_counts=True))
                    if len(held[name]) > 8:
                        held[name] = [merged(held[name])]
        for name, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    def merged(parts):
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    got = rows.where(draw < share).dropDuplicates(["lang", "own"]).select("lang", "body").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang_of, code, n = np.array(got.column("lang").to_pylist(), object), got.column("code").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    names = sorted(set(lang_of.tolist()))
    return ContextTrees(names, [code[lang_of == x] for x in names], [n[lang_of == x] for x in names])


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of `docs` and the predicted language with its score."""
    body = fresh_name(docs.columns, "body")
    names = [*trees.names, "und"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, body, 1 << 20):
                buf, offs = flat(part.column(part.num_columns - 1))
                pick, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                told = has_letter(buf, offs) & bool(trees.names)
                if told.any():
                    bits = trees.text_bits(buf, offs)
                    weight = np.minimum(1.0, EVIDENCE / np.maximum(1, np.diff(offs)))
                    more = (bits - bits.min(axis=1, keepdims=True)) * weight[:, None]
                    pick = np.where(told, bits.argmin(axis=1), pick)
                    score = np.where(told, 1 / np.exp2(-more).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([names[i] for i in pick], pa.string()), pa.array(score)],
                                                 names=[*part.schema.names[:-1], lang_col, score_col])

    schema = docs.select(*docs.columns, F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema
    return docs.withColumn(body, F.col(text)).mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out (crc32 of the id modulo 5)."""
    fold = F.crc32(F.col(doc_id).cast("string")) % 5
    trees = learn(docs, fold != 0, text, lang)
    own = fresh_name([doc_id], "text_of")
    judged = predict(docs.select(doc_id, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col(text).alias(own)), trees, own)
    return judged.select(doc_id, "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language is told with `least_score` or more."""
    trees = learn(docs, F.crc32(F.col(doc_id).cast("string")) % 5 != 0, text, lang)
    pred, score = fresh_name(docs.columns, "lang_pred"), fresh_name(docs.columns, "lang_score")
    return predict(docs, trees, text, pred, score).where((F.col(pred) != "und") & (F.col(score) >= least_score)).select(*docs.columns)
