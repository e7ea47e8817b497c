"""Near copies against brute force, with large groups cut into chunks, and the union of edges."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from provisio.llm import grouping, superminhash
from provisio.llm.common import flat


def brute_sets(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, percent=85):
    sets, root = brute_sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids else None
    return collections.Counter((rows[i][0], len(sets[i]), out[i], rows[i][0] == out[i]) for i in range(len(rows)))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    rows = []
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = fresh(60)
    for _ in range(30):  # a passage that many texts share
        rows.append(" ".join(shared + fresh(rng.randrange(40, 90))))
    base = fresh(200)
    rows += [changed(rng, base, rng.randrange(1, 5)) for _ in range(70)]  # one large group, not all links within
    chain = fresh(150)
    for _ in range(12):
        rows.append(changed(rng, chain, 1))
        chain = rows[-1].split()
    for _ in range(8):
        t = fresh(rng.randrange(3, 120))
        rows += [" ".join(t), " ".join(t).upper(), changed(rng, t, 1), "  " + "\n".join(t)]
    rows += [" ".join(fresh(rng.randrange(1, 300))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("chunks", [(4096, 1024), (16, 12)])
def test_near_copies_equal_brute_force(spark, monkeypatch, chunks):
    monkeypatch.setattr(superminhash, "SIGNATURE_CHUNK", chunks[0])
    monkeypatch.setattr(superminhash, "SET_CHUNK", chunks[1])
    monkeypatch.setattr(grouping, "PIVOTS", 2)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, body string, node int").repartition(5)
    assert collections.Counter(map(tuple, superminhash.near_copies(docs).collect())) == brute_components(rows)


def test_awkward_rows(spark, awkward, rows, nothing):
    got = collections.Counter(map(tuple, superminhash.near_copies(awkward).collect()))
    assert got == brute_components([r[:2] for r in rows])
    assert superminhash.near_copies(nothing).count() == 0
    left = superminhash.keep_one(awkward)
    assert left.columns == awkward.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    # one of each group, both rows without an id, and one row of each repeated id
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 11, 12] and ids.count(None) == 2


def test_one_row_of_each_group_whatever_the_ids(spark, awkward):
    ids = [r.doc_id for r in superminhash.keep_one(awkward, unique_ids=False).select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 11, 12, 12] and ids.count(None) == 2
    t = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(None, t[0]), (None, t[0].upper()), (None, t[1]), (None, t[0]), (5, t[2]), (3, t[2]), (5, t[3]), (7, t[4]), (7, t[4]), (7, t[4] + " more"), (None, t[4]), (8, t[5]),
            (None, ""), (None, ""), (8, None)]
    docs = spark.createDataFrame([(*r, "x", 1, {"a": i}) for i, r in enumerate(rows)], "doc_id long, text string, node string, at int, row map<string,int>").repartition(4)
    got = [(r.doc_id, (r.text or "").lower()) for r in superminhash.keep_one(docs, unique_ids=False).collect()]
    assert sum(i == 7 for i, _ in got) == 1  # of three rows in one group
    want = [(None, ""), (None, ""), (None, t[0]), (None, t[1]), (3, t[2]), (5, t[3]), (8, t[5]), (8, "")]
    assert collections.Counter(x for x in got if x[0] != 7) == collections.Counter(want)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85, 0.95):
        a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        b = np.concatenate([a[:int(400 * 2 * share / (1 + share))], rng.integers(0, 1 << 62, 400).astype(np.uint64)])[:400]
        s = superminhash.signatures([np.unique(a), np.unique(b)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12
    one = superminhash.signatures([np.array([5], np.uint64)])[0]
    assert sorted(one.astype(int).tolist()) == list(range(superminhash.SLOTS))  # a permutation of ranks


def test_signature_is_the_least_offer_over_all_rounds():
    """Early stopping changes nothing: against all rounds of every element, with a smaller number of slots."""
    items = np.arange(40, dtype=np.uint64) * np.uint64(977)
    got = superminhash.signatures([items[:3], items], 16)
    single = [superminhash.signatures([items[i:i + 1]], 16)[0] for i in range(40)]
    assert (got[0] == np.min(single[:3], axis=0)).all() and (got[1] == np.min(single, axis=0)).all()


def test_shingles_of_short_texts():
    sets = superminhash.shingle_sets(*flat(pa.array(["a b", "A  b", "b a", "", None, "a b c d e", "a b c d e f"])))
    assert [len(s) for s in sets] == [1, 1, 1, 0, 0, 1, 2]
    assert sets[0] == sets[1] and sets[0] != sets[2] and sets[5][0] in sets[6]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    name = lambda i: i.to_bytes(2, "big")
    got = {bytes(r.node): bytes(r.label) for r in grouping.components(spark.createDataFrame([(name(a), name(b)) for a, b in pairs], grouping.EDGE)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {name(x): name(find(x)) for p in pairs if p[0] != p[1] for x in p}
    assert grouping.components(spark.createDataFrame([], grouping.EDGE)).count() == 0


def test_regular_long_words_are_different_words(spark):
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, a), (2, b), (3, a), (4, f"x {a} y z w"), (5, f"x {b} y z w")]
    got = superminhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows)


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 3, 400, 0, 2500, 40)]
    want = superminhash.signatures(sets)
    for size in (1, 7, 300):
        monkeypatch.setattr(superminhash, "BLOCK", size)
        assert np.array_equal(superminhash.signatures(sets), want)
    assert (want[0] == superminhash.SLOTS).all() and (want[5] < superminhash.SLOTS).all()
