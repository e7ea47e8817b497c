"""The models against plain versions: one tree by exhaustive search, prediction by partial matching with dictionaries,
pooling and gradients of the network by definition."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from provisio.llm import boosting, ppm_language, quality_net
from provisio.llm.common import flat


# --- trees -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", range(8))
def test_a_tree_takes_the_best_splits(seed):
    """Every split of a fitted tree gains as much as the best of all features and cuts, and its leaves are the steps they should be."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (120, 4)).astype(np.float32)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 5) | (rng.random(120) < 0.1)).astype(np.float32)
    own = boosting.BoostedTrees(trees=1, depth=3, bins=8).fit(x, y)
    mean = float(y.mean())
    assert own.base == pytest.approx(math.log(mean / (1 - mean)), rel=1e-6)
    grad, hess = y - mean, np.full(len(y), mean * (1 - mean))
    score = np.zeros(len(y))

    def gain(rows, j, cut):
        left = x[rows, j] <= cut
        g, h, gl, hl = grad[rows].sum(), hess[rows].sum(), grad[rows][left].sum(), hess[rows][left].sum()
        if hl < 1 or h - hl < 1:
            return 0.0
        return gl ** 2 / (hl + own.ridge) + (g - gl) ** 2 / (h - hl + own.ridge) - g ** 2 / (h + own.ridge)

    def walk(node, level, rows):
        if level == own.depth:
            leaf = own.leaf[0, node - (1 << own.depth) + 1]
            assert leaf == pytest.approx(own.rate * grad[rows].sum() / (hess[rows].sum() + own.ridge), rel=1e-4, abs=1e-6)
            score[rows] = own.base + leaf
            return
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, own.bins + 1)[1:-1])).astype(np.float32) for j in range(4)]
        best = max(gain(rows, j, c) for j in range(4) for c in cuts[j])
        j, cut = own.feature[0, node], own.limit[0, node]
        if np.isinf(cut):
            assert best <= 1e-5
        else:
            assert cut in cuts[j] and gain(rows, j, cut) == pytest.approx(best, abs=1e-5)
        goes = x[rows, j] <= cut
        walk(2 * node + 1, level + 1, rows[goes])
        walk(2 * node + 2, level + 1, rows[~goes])

    walk(0, 0, np.arange(len(y)))
    assert np.allclose(own.chance(x), 1 / (1 + np.exp(-score)), atol=1e-6)


def test_more_trees_lower_the_loss():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(np.float32)
    loss = [-np.mean(np.log(np.where(y > 0, p, 1 - p))) for n in (1, 10, 60) for p in [boosting.BoostedTrees(trees=n, depth=3).fit(x, y).chance(x)]]
    assert loss[0] > loss[1] > loss[2]


# --- prediction by partial matching ------------------------------------------------------------------------------------
def plain_counts(texts):
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        data = b"\n" * ppm_language.ORDER + t.encode()
        for i in range(ppm_language.ORDER, len(data)):
            for k in range(ppm_language.ORDER + 1):
                counts[data[i - k:i]][data[i]] += 1
    return counts


def plain_bits(counts, text):
    data, bits = b"\n" * ppm_language.ORDER + text.encode(), 0.0
    for i in range(ppm_language.ORDER, len(data)):
        for k in range(ppm_language.ORDER, -1, -1):
            seen = counts.get(data[i - k:i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_dictionaries():
    rng = random.Random(4)
    alphabets = ["abcd ", "abxyzé ", "日本 \n"]
    taught = [["".join(rng.choice(a) for _ in range(rng.randrange(60))) for _ in range(30)] for a in alphabets]
    codes, counts = [], []
    for texts in taught:
        c, n = np.unique(ppm_language.grams(*flat(pa.array(texts))), return_counts=True)
        codes.append(c)
        counts.append(n)
    trees = ppm_language.ContextTrees(["x", "y", "z"], codes, counts)
    tables = [plain_counts(t) for t in taught]
    asked = ["", "a", "abcd abcd", "日本é\x00zz", *("".join(rng.choice("abcdxyzé日 Q") for _ in range(rng.randrange(80))) for _ in range(40))]
    got = trees.text_bits(*flat(pa.array(asked)))
    assert np.allclose(got, [[plain_bits(t, a) for t in tables] for a in asked], rtol=1e-4, atol=1e-3)


# --- quality network ---------------------------------------------------------------------------------------------------
TEXTS = ["one two three two one", "", "A b, c! one", None, "zz " * 40, "one\ntwo  three 4711 $$$"]


def test_context_sums_by_definition():
    buf, offs = flat(pa.array(TEXTS))
    own = quality_net.ContextSums()
    own.add(buf, offs)
    word, shape, doc = quality_net.tokens(buf, offs)
    want = np.zeros_like(own.sums)
    for i in range(len(word)):
        around = np.zeros(quality_net.DIM + 1, np.int64)
        around[-1] = 1
        for j in range(max(0, i - quality_net.REACH), min(len(word), i + quality_net.REACH + 1)):
            if j != i and doc[j] == doc[i]:
                around[:-1] += own.index[0][word[j]].astype(np.int64) + own.index[1][shape[j]]
        want[0, word[i]] += around
        want[1, shape[i]] += around
    assert np.array_equal(own.sums, want)


def test_context_sums_of_many_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 9], "body string")
    one = quality_net.context_sums(docs.coalesce(1))
    monkeypatch.setattr(quality_net, "FAN_IN", 2)     # many rounds' worth of groups
    assert np.array_equal(quality_net.context_sums(docs.repartition(23)), one) and one.any()
    assert not quality_net.context_sums(docs.limit(0)).any()


def test_pooling_by_definition():
    buf, offs = flat(pa.array(TEXTS))
    sums = quality_net.ContextSums()
    sums.add(buf, offs)
    pooled = quality_net.DocumentVectors(sums.sums)
    word, shape, doc = quality_net.tokens(buf, offs)
    got = pooled.pool(buf, offs)
    d = quality_net.DIM
    for i in range(len(TEXTS)):
        own = np.flatnonzero(doc == i)
        want = np.zeros(pooled.size)
        if len(own):
            for k, bucket in enumerate((word, shape)):
                w = pooled.weight[k][bucket[own]].astype(float)
                v = pooled.table[k][bucket[own]].astype(float) / w[:, None]
                want[k * d:(k + 1) * d] = sum(a * b for a, b in zip(w, v, strict=True)) / w.sum()
                want[2 * d + k] = math.sqrt(sum(x * x for x in want[k * d:(k + 1) * d]))
            v = pooled.table[0][word[own]].astype(float) / pooled.weight[0][word[own]].astype(float)[:, None]
            want[2 * d + 2] = sum(float(a @ b) for a, b in zip(v[1:], v[:-1], strict=True)) / len(own)
            want[2 * d + 3] = math.log1p(len(own))
        assert np.allclose(got[i], want, atol=1e-4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(20, 6)), (rng.random(20) > 0.4).astype(float)
    w = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]

    def loss():
        z = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        return np.logaddexp(0, np.where(y > 0, -z, z)).mean() + quality_net.DECAY / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    for a, g in zip(w, quality_net.gradients(w, x, y), strict=True):
        for at in np.ndindex(a.shape):
            keep = a[at]
            a[at] = keep + 1e-5
            up = loss()
            a[at] = keep - 1e-5
            down = loss()
            a[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    held = np.arange(600) % 5 == 0
    net = quality_net.Net().fit(x, y, held)
    z = net.odds(x[held])
    loss = {k: np.logaddexp(0, np.where(y[held] > 0, -z, z) / k).mean() for k in np.geomspace(0.25, 8, 61)}
    assert loss[min(loss, key=lambda k: abs(k - net.temperature))] == min(loss.values())
    assert np.mean((net.score(x[held]) > 0.5) == y[held]) > 0.7
