"""Mixing, reversed search and the filter audit against plain Python on awkward rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from provisio.llm import common, filter_audit, mixing, reversed_search
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- mixing ----------------------------------------------------------------------------------------------------------
def plain_targets(sizes, shares=(1, 2, 3), most=3):
    """The shares as told, round by round, in fractions of whole numbers."""
    from fractions import Fraction
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    share = {n: shares[i % len(shares)] for i, n in enumerate(names)}
    out, rest, live = {}, Fraction(sum(sizes.values())), set(names)
    while live:
        level = rest / sum(share[n] for n in live)
        over = {n for n in live if level * share[n] > most * sizes[n]}
        if not over:
            out.update({n: level * share[n] for n in live})
            break
        for n in over:
            out[n] = Fraction(most * sizes[n])
            rest -= out[n]
        live -= over
    return out


def test_mix_of_awkward_rows(spark, awkward, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    got = mixing.mix(awkward).collect()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    assert collections.Counter((r.doc_id, r.size, r.source) for r in got) == collections.Counter((r[0], n, r[3]) for r, n in zip(rows, size, strict=True))
    by_source = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        by_source[r[3]] += n
    want = plain_targets(by_source)
    for source, own in itertools.groupby(sorted(got, key=lambda r: str(r.source)), key=lambda r: r.source):
        own = list(own)
        assert all(r.source_size == by_source[source] and abs(r.target - float(want[source])) < 1e-9 for r in own)
        assert sum(r.taken for r in own) == math.floor(want[source])
        epochs = math.floor(want[source]) // max(1, by_source[source])
        part = [r for r in own if r.size and r.taken not in (epochs * r.size, (epochs + 1) * r.size)]
        assert len(part) <= 1 and all(epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size for r in own)
    again = mixing.mix(awkward.repartition(7, "n_words").select("score", "source", "text", "doc_id")).collect()
    assert collections.Counter(again) == collections.Counter(got)
    assert mixing.mix(awkward.limit(0)).collect() == []


def test_mix_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " \n", None)], "doc_id long, text string, source string")
    assert {(r.source, r.size, r.target, r.taken) for r in mixing.mix(docs).collect()} == {("a", 0, 0.0, 0), ("b", 0, 0.0, 0), (None, 0, 0.0, 0)}


@pytest.mark.parametrize("sizes", [{f"s{i:02d}": (i * 37) % 101 for i in range(40)}, {"a": 1, "b": 10**12, "c": 5}, {"z": 7}, {"é": 3, "e": 3, "Z": 3, None: 3}])
def test_targets(spark, sizes):
    known = spark.createDataFrame([(f"={n}" if n is not None else "", n, s) for n, s in sizes.items()], "name string, source string, source_size long").repartition(5)
    want = plain_targets(sizes)
    for r in mixing.targets(known).collect():
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12) and r.words == math.floor(want[r.source])


def test_keys_sample_by_weight(spark):
    """Of equal sizes, rows of weight 4 come among the first tenth four times as often as those of weight 1."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a word").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2 * 3 + 1).alias("w"))
    key = docs.select("w", (-F.log(mixing.uniform(F.col("doc_id"), F.md5("text"), 5)) / F.col("w")).alias("key"))
    first = key.orderBy("key").limit(1000).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in first}
    assert 3.2 < n[4] / n[1] < 5
    got = mixing.mix(docs, weight=F.col("w").cast("double")).agg(F.sum("taken"), F.max("taken")).first()
    assert tuple(got) == (40000, 2)


# --- reversed search -------------------------------------------------------------------------------------------------
def plain_search(docs, items, k=20):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counted = [(d, collections.Counter(TERM.findall((t or "").translate(low)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(w for _, c in counted for w in c)
    out = collections.Counter()
    for item, text in set(items):
        scores = []
        query = collections.Counter(TERM.findall((text or "").translate(low)))
        for d, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out.update((item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


ITEMS = [(1, "The QUICK brown fox, the fox!"), (1, "another text"), (2, None), (3, ""), (4, "Zoë läuft — ½"), (5, "$$$"), (6, "4711 nowhere"), (1, "another text"), (None, "whales and harbour")]


@pytest.mark.parametrize("k, small", [(20, False), (2, True)])
def test_search_of_awkward_rows(spark, awkward, rows, monkeypatch, k, small):
    if small:  # many blocks, pieces and chunks
        monkeypatch.setattr(reversed_search, "BLOCK_BYTES", 60)
        monkeypatch.setattr(common, "PIECE", 40)
        monkeypatch.setattr(reversed_search, "SCORES", 3)
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, doc_id string, rank int")
    got = reversed_search.search(awkward, items, k)
    want = plain_search([r[:2] for r in rows], ITEMS, k)
    assert collections.Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want and want
    assert reversed_search.search(awkward.limit(0), items).count() == 0 and reversed_search.search(awkward, items.limit(0)).count() == 0


def test_terms_are_runs_of_letters_digits_and_all_beyond_ascii():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 _-@[`{\x7f\x00 éßİſ漢𝒳\n") for _ in range(rng.randrange(60)))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert reversed_search.terms_of(t.encode()) == collections.Counter(x.encode() for x in TERM.findall(low))
    long = ("Ab c" * 7 + "é ") * 300_000
    assert reversed_search.terms_of(long.encode()).total() == len(TERM.findall(long))


def test_heaps_keep_the_best():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 6, (500, 7))
    docs = rng.permutation(500)
    heaps = reversed_search.Heaps(7, 9)
    for at in range(0, 500, 13):
        heaps.offer(scores[at:at + 13], docs[at:at + 13])
    for i in range(7):
        want = sorted((-s, d) for s, d in zip(scores[:, i].tolist(), docs.tolist(), strict=True) if s)[:9]
        assert [(-s, d) for s, d in zip(heaps.score[heaps.item == i].tolist(), heaps.doc[heaps.item == i].tolist(), strict=True)] == want


# --- filter audit ----------------------------------------------------------------------------------------------------
def plain_audit(rows, labels):
    good, toxic = ({d for d, *told in labels if d is not None and told[i] == 1} for i in (0, 1))
    flagged = []
    for d, t, part, *_ in rows:
        t = t or ""
        ws = WORD.findall(t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d is not None and any(o[0] is not None and o[0] < d and (o[1] or "") == t for o in rows)}
        flagged.append((part or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, shapley = {}, collections.Counter()
    for part in {p for p, *_ in flagged}:
        own = [x[1:] for x in flagged if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                earlier = set(order[:step - 1])
                lost = [x for x in own if f in x[0] and not x[0] & earlier]
                out[part, "".join(order), step] = (sum(not x[0] & set(order[:step]) for x in own), len(lost), sum(f in x[0] and bool(x[0] & earlier) for x in own),
                                                   sum(x[0] == {f} for x in own), sum(x[1] for x in lost), sum(x[2] for x in lost))
                shapley[part, f] += len(lost)
    return collections.Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_of_awkward_rows(spark, awkward, rows, monkeypatch):
    monkeypatch.setattr(common, "PIECE", 50)
    labels = [(1, 1, 0), (2, 0, 1), (9, 1, 1), (12, None, 1), (12, 1, None), (None, 1, 1), (99, 1, 1), (7, 1, 0)]
    told = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_interactions(awkward, told)
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert got.columns == names
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.filter_interactions(awkward.limit(0), told).count() == 0


def test_walk_of_random_cells():
    rng = np.random.default_rng(3)
    for n in (1, 3, 5):
        masks = rng.permutation(1 << n)[:rng.integers(1, (1 << n) + 1)].tolist()
        counts = rng.integers(0, 50, (len(masks), 3))
        left = filter_audit.states(masks, counts, n)
        for active in range(1 << n):
            assert left[active].tolist() == [sum(int(c[j]) for m, c in zip(masks, counts, strict=True) if not m & active) for j in range(3)]


def test_words_of_long_texts_in_pieces():
    t = ("Aé b\tc " * 900_000 + "x" * 9_000_000).encode()
    assert filter_audit.text_failures(t) == 0b0010 | (100 * t.count(b"A") > 3 * len(t.decode())) << 2
    assert b" ".join(common.pieces(b"ab cd  ef", size=1)).split() == b"ab cd ef".split()
