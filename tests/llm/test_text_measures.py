"""Words, quality rules, packing and encoding against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from provisio.llm import bpe, host_rules, packing, textvec
from provisio.llm.common import flat
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.lists(st.text(st.sampled_from(list("ab #\n\t.é½日  'sS1<|>!")), max_size=60) | st.none(), max_size=6)


def brute_measure(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, n_lines = set(), 0, 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), n_lines, dup, len(covered)]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_measure_equals_brute_force(texts):
    got = host_rules.measure(*flat(pa.array(texts, pa.string())))
    assert [[int(got[m][i]) for m in host_rules.MEASURES] for i in range(len(texts))] == [brute_measure(t) for t in texts]


def test_span_hash_tells_spans_apart_and_not_places():
    buf = np.frombuffer(b"abc abd abc a", np.uint8)
    h = textvec.Spans(buf).hash(np.array([0, 4, 8, 12]), np.array([3, 7, 11, 13]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def thue_morse(n, one="a", two="b"):
    """A text and its mirror that agree under any polynomial modulo a power of two, once they are long enough."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((one, two)[b] for b in bits), "".join((two, one)[b] for b in bits)


THUE = [t for n in (64, 128, 1024, 2048, 4096, 65536) for t in thue_morse(n)]


def test_regular_texts_do_not_collide():
    buf, offs = flat(pa.array(THUE * 2))
    first, kind = textvec.distinct(buf, offs[:-1], offs[1:])
    assert len(first) == len(THUE) and (kind[:len(THUE)] == kind[len(THUE):]).all()
    assert len(set(textvec.Spans(buf).hash(offs[:len(THUE)], offs[1:len(THUE) + 1]).tolist())) == len(THUE)
    assert [brute_measure("\n".join(THUE[:6]))[4], int(host_rules.measure(*flat(pa.array(["\n".join(THUE[:6])])))["n_dup_lines"][0])] == [0, 0]


def test_ids_of_regular_texts_equal_the_library():
    for enc, tok in ((_byte(), _byte().whole), _word()):
        ids, at = enc.encode(*flat(pa.array(THUE)))
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(THUE))] == [tok.encode(t, add_special_tokens=False).ids for t in THUE]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=12), st.sampled_from([0, 7, 64]))
def test_long_spans_hash_as_polynomials(texts, pad):
    """Against whole numbers, over several blocks, with spans of equal bytes at different places."""
    data = b"".join(texts) + b"x" * pad
    data = data * (1 + 140_000 // max(1, len(data)))
    buf = np.frombuffer(data, np.uint8)
    start = np.array([0, 1, 65_500, len(data) // 2]) % max(1, len(data))
    end = np.minimum(len(data), start + np.array([70, 300, 66_000, 65_536]))
    got = textvec.Spans(buf)._polynomial(start, end)
    for s, e, h in zip(start.tolist(), end.tolist(), got.tolist(), strict=True):
        want, power = 0, 1
        for c in data[s:e]:
            want, power = (want + (c + 1) * power) % textvec.PRIME, power * textvec.BASE % textvec.PRIME
        assert h == want


def test_spans_with_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(textvec.Spans, "hash", lambda self, start, end: (end - start) % 2)
    texts = ["ab", "cd", "ab", "abcd", "x", "y", "x", "", "abcd" * 30, "abce" * 30, "abcd" * 30]
    buf, offs = flat(pa.array(texts))
    first, kind = textvec.distinct(buf, offs[:-1], offs[1:])
    assert len(first) == len(set(texts)) and [texts[i] for i in first[kind]] == texts


def test_first_of_each_kind():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        code = rng.integers(0, n, 40)
        first, kind = textvec.first_of_each(code, n)
        _, want, inverse = np.unique(code, return_index=True, return_inverse=True)
        assert np.array_equal(first, want) and np.array_equal(kind, inverse)


def test_host_prior():
    assert host_rules.beta_prior(0, 0, 0, 0, 0) == (0.0, float("inf"))
    # hosts alike but for chance: everything is shrunk to the mean
    n, f = np.array([100.0, 100, 100]), np.array([30.0, 31, 29])
    assert host_rules.beta_prior(n.sum(), f.sum(), (f * f / n).sum(), (n * n).sum(), 3) == (0.3, float("inf"))
    # hosts far apart: hardly any shrinking
    f = np.array([0.0, 95, 5])
    p, strength = host_rules.beta_prior(n.sum(), f.sum(), (f * f / n).sum(), (n * n).sum(), 3)
    assert strength < 2 and abs(p - 1 / 3) < 1e-9


def test_quality_rules_on_awkward_rows(awkward, rows, nothing):
    got = host_rules.quality_rules(awkward)
    assert sorted(got.columns) == sorted([*awkward.columns, "quality"])
    want = collections.Counter((r[0], *brute_measure(r[1])) for r in rows)
    q = F.col("quality")
    found = got.select("doc_id", *(q[m].alias(f"m_{m}") for m in host_rules.MEASURES)).collect()
    assert collections.Counter(tuple(r) for r in found) == want
    for r in got.select("doc_id", "quality.*").collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert host_rules.quality_rules(nothing).count() == 0


def test_a_bad_host_is_rejected_and_others_stay(spark):
    good = "word%d " * 30
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), f"h{i % 4}") for i in range(400)]
    rows += [(1000 + i, "too short", "bad") for i in range(180)] + [(2000 + i, " ".join(f"b{i}x{j}" for j in range(30)), "bad") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = {r.doc_id for r in host_rules.keep_good(docs).select("doc_id").collect()}
    assert good and left == set(range(400))


@settings(max_examples=120, deadline=None)
@given(TEXTS)
def test_byte_ids_equal_the_library(texts):
    enc = _byte()
    ids, at = enc.encode(*flat(pa.array(texts, pa.string())))
    want = [enc.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == want


@settings(max_examples=120, deadline=None)
@given(TEXTS)
def test_word_ids_and_decoding_equal_the_library(texts):
    enc, tok = _word()
    ids, at = enc.encode(*flat(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        own = ids[at[i]:at[i + 1]]
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert own.tolist() == want
        assert enc.decode(own).decode() == tok.decode(want, skip_special_tokens=False)


def test_special_and_long_words_equal_the_library():
    enc, tok = _word()
    texts = ["x<|endoftext|>Y <|startoftext|>", "ΣΑΣ ΟΔΟΣ", "İstanbul ǅ", "aB" * 3000, "they'LL don't 12 ٣", "<|endoftext|", "a" * 700 + "b" * 700, "\x1ca\x1d"]
    ids, at = enc.encode(*flat(pa.array(texts)))
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pool_limit_changes_no_result():
    enc, tok = _word()
    enc.pool.max_chunks = 3
    for t in ("a b c d e f", "f e d", "a b q"):
        ids, _ = enc.encode(*flat(pa.array([t])))
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


_made = {}


def _byte():
    return _made.setdefault("b", packing.ByteBpe(BYTE))


def _word():
    enc = _made.setdefault("w", bpe.ForcedBpe(WORD))
    return enc, _made.setdefault("t", Tokenizer.from_file(WORD))


def test_encoding_query_on_awkward_rows(awkward, rows, nothing):
    _, tok = _word()
    want = collections.Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.digests(awkward, WORD).collect())) == want
    full = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(awkward, WORD).collect()}
    assert (6, tuple(tok.encode("one two").ids), "one</w> two</w>") in full
    assert bpe.digests(nothing, WORD).count() == 0


def check_pieces(pieces, texts, tok, size=1024):
    """Every id in one piece, sequences gapless, nothing padded."""
    sequences, docs = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens] += 1
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at and length > 0
            at += length
        assert at <= size and at & (at - 1) == 0
    total = 0
    for doc_id, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        mine = sorted({(s, n, c) for (d, s, n, c, k) in docs if d == doc_id and k == len(ids)})
        assert any(s == 0 for s, _, _ in mine)
        for s, n, c in mine:
            if sum(x[0] == doc_id for x in texts) == 1:
                assert zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == c
        if sum(x[0] == doc_id for x in texts) == 1:
            assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:i]) for i in range(len(mine))] and sum(n for _, n, _ in mine) == len(ids)
    assert sum(p.length for p in pieces) == total


def test_packing_awkward_rows(awkward, rows, nothing):
    tok = Tokenizer.from_file(BYTE)
    check_pieces(packing.pack(awkward, BYTE).collect(), [(r[0], r[1]) for r in rows], tok)
    assert packing.pack(nothing, BYTE).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = packing.Packer(32, 0)
        p.counts[1:32] = rng.integers(0, 4, 31)
        s = int(rng.integers(1, 32))

        def after(h, s=s, p=p):
            c = p.counts.copy()
            c[h] -= h > 0
            if h + s < 32:
                c[h + s] += 1
            return int((c[1:32] ** 2).sum())

        open_levels = [h for h in range(1, 32 - s + 1) if p.counts[h]] + [0]
        best = min(map(after, open_levels))
        assert p.level(s) == max(h for h in open_levels if after(h) == best)


def test_open_windows_are_bounded_and_nothing_is_lost():
    p = packing.Packer(1024, 0, max_open=16)
    for i in range(500):
        p.add(i, np.arange(600, dtype=np.uint32) + i)
        assert p.n_open <= 17
    p.close()
    got = collections.defaultdict(list)
    for d, start, length, *_ in p.rows:
        got[d].append((start, length))
    assert all(sorted(v)[0][0] == 0 and sum(n for _, n in v) == 600 for v in got.values()) and len(got) == 500
