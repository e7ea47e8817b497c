r"""Quality rules with host verdicts (operator 2).

Each whole text is measured once (words, symbols, repeated lines, repeated 8-word windows).  Rule failures are summed by
host, every host's failure rates are shrunk towards the corpus with a beta prior estimated from all hosts (analysis of
variance of the beta-binomial), and a host whose shrunk rate passes `max_host_rate` under any rule is rejected with all
its documents.

Defined cases: null or empty text has no word and fails the base rule; a null host has no verdict of its own (its
documents are judged by the base rule alone); repeated rows are measured and counted each; an empty table gives an empty
result; columns that are not carried play no part.  A hot host is aggregated map-side, and the join back deals each
host's rows over SALTS groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, fresh_name, slices, stored
from .textvec import SPACE, U, Spans, count_in, distinct, lines, mix, words

WINDOW = 8
#: A host's rows meet its verdict in so many groups.
SALTS = 64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
RULES = ["few_words", "repeats", "symbols", "dup_lines"]


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each document of a flat buffer."""
    n_docs = len(offs) - 1
    lo, hi = offs[:-1], offs[1:]
    start, end, doc = words(buf, offs)
    per_doc = lambda d: np.bincount(d, minlength=n_docs).astype(np.int64)
    out = {"n_words": per_doc(doc),
           "word_chars": count_in(~SPACE[buf] & ((buf & 0xC0) != 0x80), lo, hi),
           "n_symbols": count_in(SYMBOLS[buf], lo, hi)}
    salt = mix(np.arange(1, n_docs + 1, dtype=U))
    l_start, l_end, l_doc = lines(buf, offs)
    full = count_in(~SPACE[buf], l_start, l_end) > 0
    l_start, l_end, l_doc = l_start[full], l_end[full], l_doc[full]
    _, first = np.unique(l_doc * (len(l_doc) + 1) + distinct(buf, l_start, l_end)[1], return_index=True)
    out["n_lines"] = per_doc(l_doc)
    out["n_dup_lines"] = out["n_lines"] - per_doc(l_doc[first])
    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    n = len(start) - WINDOW + 1
    if n > 0:
        h = Spans(buf).hash(start, end)
        key = np.zeros(n, U)
        for j in range(WINDOW):
            key = key * U(0x2545F4914F6CDD1D) + h[j:n + j]
        key = mix(key ^ salt[doc[:n]])
        at = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
        order = at[np.argsort(key[at], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        step = np.zeros(len(start) + 1, np.int64)
        step[order[twice]] += 1
        step[order[twice] + WINDOW] -= 1
        covered = np.cumsum(step)[:-1] > 0
        out["n_repeat_words"] = per_doc(doc[covered])
    return out


def beta_prior(n: float, f: float, f2_n: float, n2: float, hosts: int) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the beta prior over host failure rates, from sums over all hosts: documents,
    failures, failures**2 / documents, documents**2.  No spread between hosts beyond chance gives infinite strength."""
    if not n:
        return 0.0, math.inf
    p = f / n
    if hosts < 2 or n <= hosts:
        return p, 1.0
    between, within = (f2_n - f * f / n) / (hosts - 1), (f - f2_n) / (n - hosts)
    n0 = (n - n2 / n) / (hosts - 1)
    rest = between + (n0 - 1) * within
    rho = (between - within) / rest if rest > 0 else 0.0
    return p, (1 - rho) / rho if rho > 0 else math.inf


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None,
                  max_host_rate: float = 0.5, max_symbols_pct: int = 30, max_dup_lines_pct: int = 30) -> DataFrame:
    """`carry` columns (all by default; the host is always carried) and a struct `quality` with the measures, the rule failures, base_failed,
    host_rejected and kept."""
    carry = list(dict.fromkeys([*(carry if carry is not None else docs.columns), host]))
    own, body, key = (fresh_name(docs.columns, x) for x in ("measures", "body", "quality"))
    kind = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    arrow = pa.struct([pa.field(m, pa.int64(), False) for m in MEASURES])

    def run(batches):
        for batch in batches:
            for part in slices(batch, body, 1 << 20):
                m = measure(*flat(part.column(part.schema.get_field_index(body))))
                got = pa.StructArray.from_arrays([pa.array(m[x]) for x in MEASURES], fields=list(arrow))
                rest = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*rest, got], names=[*carry, own])

    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(own, kind)])
    measured = stored(docs.select(*carry, F.col(text).alias(body)).mapInArrow(run, schema), "quality-measures")
    m = F.col(own)
    fails = {"few_words": m.n_words < 20, "repeats": 100 * m.n_repeat_words > 30 * m.n_words,
             "symbols": 100 * m.n_symbols > max_symbols_pct * m.n_words,
             "dup_lines": 100 * m.n_dup_lines > max_dup_lines_pct * m.n_lines}
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(fails[r].cast("long")).alias(r) for r in RULES))
    tot = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                    *(F.sum(r).alias(r) for r in RULES),
                    *(F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in RULES)).first()
    bad = F.lit(False)
    for r in RULES:
        p, strength = beta_prior(tot.n or 0, tot[r] or 0, tot[f"{r}_sq"] or 0, tot.n2 or 0, tot.hosts)
        rate = F.lit(p) if math.isinf(strength) else (F.col(r) + p * strength) / (F.col("n") + strength)
        bad = bad | (rate > max_host_rate)
    told, verdict, salt, told_salt = (fresh_name(docs.columns, x) for x in ("host_key", "host_bad", "salt", "told_salt"))
    verdicts = (hosts.select(F.col(host).alias(told), bad.alias(verdict)).where(verdict)
                .withColumn(told_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    base = fails["few_words"] | fails["repeats"]
    rejected = F.coalesce(F.col(verdict), F.lit(False))
    spread = measured.withColumn(salt, (F.monotonically_increasing_id() % SALTS).cast("int"))
    return (spread.join(verdicts, (F.col(host) == F.col(told)) & (F.col(salt) == F.col(told_salt)), "left")
            .select(*carry, F.struct(*(m[x].alias(x) for x in MEASURES), *(fails[r].alias(r) for r in RULES),
                                     base.alias("base_failed"), rejected.alias("host_rejected"),
                                     (~base & ~rejected).alias("kept")).alias(key)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` whose text passes the rules and whose host is not rejected."""
    judged = quality_rules(docs, **options)
    return judged.where(F.col(judged.columns[-1]).kept).select(*docs.columns)
