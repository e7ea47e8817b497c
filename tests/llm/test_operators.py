"""Archives, extraction, fingerprints, language, licences and quality on small tables."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
import zstandard
from provisio.llm import dom, iblt, licences, main_text, ppm_language, quality_net, warc_bundles
from provisio.llm.dom import Page


# --- archives --------------------------------------------------------------------------------------------------------
PAGES = [(1, "http://a/ü x", "<p>" + "a" * 2000), (5, "http://b", "<p>" + "a" * 2000), (3, None, "<p>" + "a" * 2000), (2, "u", None), (4, "u", "short"), (6, "u", "short"),
         (7, "u", "WARC/1.1\r\n\r\nlike a record\r\n\r\n" + "é" * 700), (None, "n", "<p>" + "a" * 2000), (8, "u", "z" * 900_000)]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    index = warc_bundles.write_archive(pages, frame_bytes=4000, bundle_bytes=6000)
    back = {r.record_id: r for r in warc_bundles.read_archive(index, payloads=True).collect()}
    assert len(back) == len(PAGES)
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        r = back[str(page_id) if page_id else "null"]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        copy = html == "<p>" + "a" * 2000 and page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", "5") if copy else ("response", None))
        assert copy or bytes(r.payload) == raw
    # any reader of Zstandard gets the same records from start to end
    by_bundle = collections.defaultdict(list)
    for r in index.orderBy("bundle", "frame", "frame_offset").collect():
        by_bundle[r.bundle].append(r)
    for bundle, rows in by_bundle.items():
        raw = open(re.sub("^file:/+", "/", bundle), "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert [len(whole)] == [sum(r.record_bytes for r in rows)] and whole.startswith(b"WARC/1.1\r\n")
    one = warc_bundles.lookup(index, spark.createDataFrame([(7,), (99,)], "page_id long")).collect()
    assert [(r.record_id, bytes(r.payload).decode()) for r in one] == [("7", PAGES[6][2])]


def test_archive_of_nothing(spark):
    assert warc_bundles.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- main text -------------------------------------------------------------------------------------------------------
SENTENCES = ["The harbour was quiet when the first boats came in.", "Nobody had expected rain, yet the clouds grew darker by the hour.", "Fish was sold at the pier & beyond, as it is every year.",
             "Later that day, the mayor spoke to a small crowd about the new bridge.", "It will be finished in spring, she said, if the weather holds."]


def site(i):
    paras = "".join(f"<p>{s.replace('&', '&amp;')} Part {i}.</p>" for s in SENTENCES)
    return (f"<html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News {i}</a></li></ul></nav>"
            f"<div class=ad>Buy this now.</div><article><h1>Harbour {i}</h1>{paras}</article><footer>&copy; site {i}</footer></body></html>")


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.createDataFrame([(i, site(i)) for i in range(60)], "page_id long, html string")
    return main_text.learn(pages)


def test_main_text_of_unseen_layouts(spark, model):
    paras = "".join(f"<p>{s}</p>" for s in SENTENCES)
    other = ("<body><div id=header><p>Daily Harbour</p><a href=/>Home</a> | <a href=/x>About</a></div><div class='entry-content'><h2>Storm</h2>" + paras +
             "</div><aside class=sidebar><h3>Popular</h3><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></aside><form class=newsletter><label>Mail</label><input></form>"
             "<section id=comments><div class=comment><p>What a nice article this is, thank you.</p></div></section><div class=cookie-notice>We use cookies.</div></body>")
    rows = [(1, "u", site(99)), (2, "u", other), (3, "u", None), (4, None, ""), (None, "u", "just text &amp; more"), (5, "u", "<p>a\n b<br>c</p><!-- x --><p>d&nbsp;e<script>x</script>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, body string")
    got = {r.page_id: r for r in main_text.extract(pages, model).collect()}
    want = "\n\n".join(["Harbour 99", *(f"{s} Part 99." for s in SENTENCES)])
    assert got[1].text == want and got[1].n_chars == len(want)
    assert all(s in got[2].text for s in SENTENCES)
    assert not any(x in got[2].text for x in ("Daily", "Popular", "Mail", "nice article", "cookies", "One"))
    assert got[3].text == got[4].text == "" and got[None].text == "just text & more"
    assert main_text.extract(pages.limit(0), model).count() == 0


def test_marks_of_real_pages_mean_nothing(spark, model):
    odd = [f'<div data-y="{v}"><p>Text of the page {i}.</p><p>And some more, as ever.</p></div>' for i, v in enumerate(["12.5", "", "50%", "0", "x"])]
    assert all(m is None for h in odd for m in Page(h).mark)
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(odd)], "page_id long, html string")
    assert {r.page_id for r in main_text.extract(pages, model).collect()} == set(range(len(odd)))
    assert main_text.learn(pages).chance(Page(odd[0]).features()).shape == (4,)
    laid = main_text.lay_out(SENTENCES, ["Home", "News"], 1)
    assert {0, 1} & set(Page(laid, marked=True).mark) and set(Page(laid).mark) == {None}


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><p>One.</p><p>Two.</p>", "One.\n\nTwo."),
    ("<head><meta charset=x><title>t</title>plain text <b>on</b>", "plain text on"),
    ("<head><title>t</title><header>Top</header><p>One.</p>", "Top\n\nOne."),
    ("<head>\n<title>t</title>\n<style>p{}</style>\n</head>\n<body><p>One.</p>", "One."),
    ("<p>A<datalist><option value=a><option value=b>bee</datalist>B</p><p>C</p>", "AB\n\nC"),
    ("<option>lost<p>A</p>", "A"),
    ("<select><option>x<option>y</select><p>A</p>", "A"),
    ("<p>A<svg viewBox='0 0 1 1' />B <math/>C</p>", "AB C"),
    ("<p>A<svg><title>x</title></SVG >B", "AB"),
    ("<p>A<svg>B<iframe src=x>C<button>D", "ABCD"),
    ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> be</p>", "let x=1 be"),
    ("<p>A<script>var a = '</scripts>';</SCRIPT>B<style>p {", "AB"),
    ("<head><title>İİİİİİİİ</title></head><body><p>İİİ<script>x</script>Iğdır<button>İ</button>dır</p>", "İİİIğdırdır"),
])
def test_unseen_parts_take_no_text_along(source, want):
    page = Page(source)
    assert page.text([True] * len(page.tag)) == want


def test_many_unseen_tags_without_an_end():
    page = Page("<p>" + "a<svg>" * 200_000)
    assert page.text([True] * len(page.tag)) == "a" * 200_000


def test_decoding_never_keeps_below_a_dropped_element():
    rng = np.random.default_rng(0)
    page = Page("<div><section><p>a</p><p>b</p></section><ul><li>c<li>d</ul></div><article><p>e</p></article>")
    n = len(page.tag)
    for _ in range(60):
        p = rng.random(n)
        keep = page.decode(p)
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, n))
        lik = lambda k, p=p: sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(1, n))
        options = [k for m in range(1 << (n - 1)) for k in [[True, *((m >> j) & 1 == 1 for j in range(n - 1))]] if all(k[page.parent[i]] or not k[i] for i in range(1, n))]
        assert abs(lik(keep) - max(map(lik, options))) < 1e-9


def test_reader_of_broken_markup():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    for source, want in (("<p>a<p>b</div></p>c", ["a", "b", "c"]), ("<script>never closed <p>x", []), ("a <b>b</i> c", ["a b c"]), ('<p title="a>b>c', ["<p title=\"a>b>c"][:0] or None), (deep, ["x"]), ("<!-- never closed <p>x", [])):
        page = Page(source)
        if want is not None:
            assert [" ".join("".join(t for _, t in b).split()) for b in page.blocks] == want


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<!", "<?x ", '<a ">"', "<a x='", '<a x=\'">', "<!--", "</", "</a ", "<svg ", "<option>", '<div class="', "<li><b>", "<a" + "b" * 50, "<p><"])
@pytest.mark.parametrize("tail", ["", ">", '">', "-->x"])
def test_reading_is_linear_in_malformed_pages(unit, tail):
    source = unit * ((1 << 20) // len(unit)) + tail
    began = time.process_time()
    Page(source)
    assert time.process_time() - began < 12


def test_tag_ends_from_the_table_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(5)
    bits = ["<", ">", '"', "'", "a", "/", " ", "=", "<!--", "-->", "<!", "<b ", "</b>", "x", "<p c='", '">']

    def read(source):
        tags, pos, out = dom.Tags(source), 0, []
        while pos < len(source) and (m := tags.after(pos)):
            out.append(m)
            pos = m[1]
        return [(a, b, n, c or "", x if n else "") for a, b, n, c, x in out]

    for _ in range(4000):
        source = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        monkeypatch.setattr(dom, "FAILED", 10 ** 9)
        want = read(source)
        monkeypatch.setattr(dom, "FAILED", -1)
        assert read(source) == want, source


def test_teaching_is_bounded_and_independent_of_files(spark):
    pages = [(i, site(i)) for i in range(30)] + [(100 + i, site(3)) for i in range(40)] + [(200, site(7) * 400)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    a, b = main_text.learn(df.repartition(2)), main_text.learn(df.repartition(7, "page_id"))
    x = Page(site(99)).features()
    assert np.array_equal(a.chance(x), b.chance(x))
    assert np.array_equal(main_text.learn(df.limit(0)).chance(x), main_text.learn(df.where("page_id = 200"), max_chars=10).chance(x))


# --- fingerprints ----------------------------------------------------------------------------------------------------
def paragraphs(t):
    out = set()
    for line in (t or "").split("\n"):
        at = 0
        for i in range(1, len(line) + 1):  # a cut before i
            gap = re.match(" *", line[i:])[0]
            after = line[i + len(gap):i + len(gap) + 1]
            if line[i - 1] in "。！？；、，を的" or gap and (line[i - 1] in ".!?;…" or line[i - 1] in "dy" and after and after in "abw"):
                out.add(line[at:i].strip(" "))
                at = i
        out.add(line[at:].strip(" "))
    return out - {""}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE_ROWS", 7)  # several ranges
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 300, 6)) + "."
    pool = [line() for _ in range(80)]
    texts = ["\n".join(rng.choice(pool, n)) for n in (3, 5, 40, 70, 1, 12, 12, 30, 9, 25, 60, 8)]
    texts += [None, "", "  \n ", "é" * 301 + ". Ünd. " + "z" * 10, texts[2], texts[2] + "\nmore", " ".join(pool[:60]), "\n".join(f"line {i}" for i in range(700))]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in iblt.edited_likeness(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, body string, digests int").repartition(4)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - likeness(t, edited)) < 1e-12, i
        assert abs(got[i].near_next - likeness(t, n)) < 1e-12, i
    assert got[7].fingerprint == got[1 + 3 * 16].fingerprint and len({r.fingerprint for r in got.values()}) == len({frozenset(paragraphs(t)) for t in texts})


CUT = [("One. Two. " + "word " * n, "One. Two. " + "tree " * n) for n in (20, 55, 56, 57, 58, 140, 400)]


def test_likeness_does_not_depend_on_length(spark):
    """Two texts that share two sentences share them at any length, and half a text without marks is still half of it."""
    rows = [(2 * i + k, t) for i, pair in enumerate(CUT) for k, t in enumerate(reversed(pair))]
    near = {r.doc_id: r.near_next for r in iblt.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(near[2 * i + 1] > 0 and abs(near[2 * i + 1] - likeness(*pair)) < 1e-12 for i, pair in enumerate(CUT))
    plain = ["the dog ran away and then it had been caught by a boy who would always be kind and warm to every animal he had around him " * 3,
             "私は本を読むのが好きで毎日新しい本を買って夜に読みます、友達も本を読みます" * 4, "今天天气很好，我们去公园玩。他说的话我不太明白，但是没关系。" * 3]
    alone = {i: iblt.edited_likeness(spark.createDataFrame([(2, t), (1, "0 " * len(t))], "doc_id long, text string")).where("doc_id = 2").first().near_edited for i, t in enumerate(plain)}
    assert all(v > 0 for v in alone.values())


def test_tables_that_never_empty_are_compared_as_sets(spark, monkeypatch):
    texts = ["\n".join(f"line {i * k}" for i in range(60)) for k in (1, 2, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: (r.near_edited, r.near_next) for r in iblt.edited_likeness(df).collect()}
    monkeypatch.setattr(iblt, "DOUBLINGS", 0)
    monkeypatch.setattr(iblt, "TABLE_WIDTH", 1)
    assert {r.doc_id: (r.near_edited, r.near_next) for r in iblt.edited_likeness(df).collect()} == want
    assert all(0 < a < 1 and 0 < b < 1 for a, b in want.values())


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert iblt.edited_likeness(spark.createDataFrame([], schema)).count() == 0
    one = iblt.edited_likeness(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    odd = iblt.edited_likeness(spark.createDataFrame([(None, "a\nb"), (None, "c"), (2, "x"), (2, "x"), (1, None)], schema)).collect()
    assert len(odd) == 5 and all(0 <= r.near_next <= 1 for r in odd)


# --- language --------------------------------------------------------------------------------------------------------
def test_languages(spark, awkward, nothing):
    rng = np.random.default_rng(2)
    say = {"en": "the and of this with ing house water light", "de": "der und nicht schön über straße wasser licht haus", "fr": "le et dans très élève château eau lumière maison"}
    rows = [(i, " ".join(rng.choice(say[x].split(), 30)), x, "s") for i, x in enumerate(rng.choice(list(say), 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = ppm_language.identify(docs).collect()
    held = [r for r in got if r.held_out]
    true = {r[0]: r[2] for r in rows}
    assert 30 < len(held) < 100 and sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = ppm_language.identify(awkward).collect()
    assert len(odd) == awkward.count() and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in odd)
    assert ppm_language.identify(nothing).count() == 0
    assert ppm_language.keep_known(awkward).columns == awkward.columns


def test_code_lengths_by_hand():
    buf, offs = np.frombuffer(b"abab", np.uint8), np.array([0, 4])
    codes, n = np.unique(ppm_language.grams(buf, offs), return_counts=True)
    trees = ppm_language.ContextTrees(["x"], [codes], [n])
    # each context of three bytes was seen once: one half for the byte, one half for the escape
    assert np.allclose(trees.text_bits(buf, offs), 4.0)
    # a new byte: escapes of orders 3 (1/2), 2 (1/2), 1 (1/2: one kind in 1 + 1) and 0 (2 of 4 + 2), then 1/256
    new = trees.lengths(ppm_language.grams(np.frombuffer(b"c", np.uint8), np.array([0, 1])))
    assert np.allclose(new, 1 + 1 + 1 - np.log2(2 / 6) + 8)


# --- licences --------------------------------------------------------------------------------------------------------
def brute_scan(text, templates, least):
    seg = [s for line in text.split("\n") for s in re.split(r"(?<=[.;:!?])\s", line)]
    norm = lambda s: re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", s.lower()).split()
    words = [norm(s) for s in seg]
    bag = lambda w: collections.Counter(zip(w, w[1:], strict=False))
    best = {}
    for name, forms in templates.items():
        for form in forms:
            b = bag(norm(form))
            for i in range(len(seg)):
                for j in range(i + 1, len(seg) + 1):
                    a = bag([x for w in words[i:j] for x in w])
                    d = 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))
                    if d >= least:
                        best[name] = max(best.get(name, 0), d)
    return best


def test_licences(spark, awkward, nothing):
    mit = licences.TEMPLATES["MIT"][0]
    texts = [mit, "intro text here.\n" + mit.replace("SOFTWARE", "PROGRAM") + "\nthe end", "Some words. Licensed under CC BY-NC 4.0. More words here", "Nothing of the kind, of the software.",
             "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "licensed UNDER the apache   license version 2 0", "", None, "x"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: {f.licence: f.dice for f in r.found} for r in licences.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_scan(t or "", licences.TEMPLATES, licences.LEAST)
        assert got[i].keys() == want.keys() and all(abs(got[i][k] - want[k]) < 1e-12 for k in want), (i, got[i], want)
    assert "MIT" in got[0] and set(got[4]) >= {"MIT", "Apache-2.0"} and not got[3]
    assert licences.scan(awkward).count() == awkward.count() and licences.scan(nothing).count() == 0


def brute_windows(text, templates, least):
    """Licence -> best Dice over all runs of words."""
    norm = lambda s: re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", s.lower()).split()
    words, best = norm(text), {}
    for name, forms in templates.items():
        for form in forms:
            b = norm(form)
            b = collections.Counter(zip(b, b[1:], strict=False))
            size = sum(b.values())
            for i in range(len(words)):
                left, both = b.copy(), 0
                for j in range(i + 1, len(words)):
                    if left[words[j - 1], words[j]] > 0:
                        left[words[j - 1], words[j]] -= 1
                        both += 1
                    d = 2 * both / (j - i + size)
                    if d >= least:
                        best[name] = max(best.get(name, 0), d)
    return best


def test_licences_inside_longer_sentences(spark):
    mit = licences.TEMPLATES["MIT"][0]
    flat_mit = " ".join(re.findall(r"\w+", mit))
    texts = ["Unless noted otherwise, all code here is licensed under the Apache License, Version 2.0.",
             "The parser, written in 2019 by the team, is released under the MIT License.", "word " * 150 + flat_mit + " more" * 90,
             "All of this work, unless it says so, is licensed under the Creative Commons Attribution 4.0 International License and nothing else", "of the software in the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_windows(t, licences.TEMPLATES, licences.LEAST)
        assert {f.licence: round(f.dice, 12) for f in got[i].found} == {k: round(d, 12) for k, d in want.items()}, i
    assert [got[i].best_licence for i in range(5)] == ["Apache-2.0", "MIT", "MIT", "CC-BY-4.0", None]
    run = got[2].found[0]
    assert run.dice == 1 and texts[2][run.start:run.start + run.n_chars] == flat_mit


def test_every_template_is_told_as_its_own_licence(spark):
    """In other words of a document, and with white space and punctuation lost."""
    forms = [(name, text) for name, forms in licences.TEMPLATES.items() for form in forms
             for text in (form, f"These are the terms of it, as they say: {form} And here it ends, more or less", "so it was told then " + " ".join(re.findall(r"\w+", form)) + " and nobody knew")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(forms)], "doc_id int, text string").repartition(8)).collect()}
    assert [(name, t[:80]) for i, (name, t) in enumerate(forms) if (got[i].best_licence, got[i].found[0].licence) != (name, name)] == []


def test_notices_of_the_gpl_family(spark):
    notice = lambda thing, kind, version: (
        f"/* Copyright (C) 2020 Jane Doe\n * This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software\n"
        f" * Foundation; either version {version} of the License, or (at your option) any later version.\n * This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        f" the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {kind} License for more details.\n"
        f" * You should have received a copy of the GNU {kind} License along with this {thing}.  If not, see <https://www.gnu.org/licenses/>.\n */\nint main() {{}}")
    want = {"GPL-2.0": ("program", "General Public", "2"), "GPL-3.0": ("program", "General Public", "3"), "AGPL-3.0": ("program", "Affero General Public", "3"),
            "LGPL-2.1": ("library", "Lesser General Public", "2.1"), "LGPL-3.0": ("library", "Lesser General Public", "3")}
    got = {r.doc_id: r.best_licence for r in licences.scan(spark.createDataFrame([(k, notice(*v)) for k, v in want.items()], "doc_id string, text string")).collect()}
    assert got == {k: k for k in want}


def test_best_runs_against_all_runs_of_words():
    rng = np.random.default_rng(9)
    forms = {"A": ["a b a b c a b"], "B": ["c c c c a", "b a c"], "C": [" ".join(rng.choice(list("abc"), 12))]}
    known = licences.Templates(forms, 0.8)
    for n in [*range(30), *[60] * 60]:
        t = "".join(str(w) + str(rng.choice([" ", " ", " ", ". ", "\n"])) for w in rng.choice(list("abcd"), n))
        raw = t.encode()
        got = known.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        words, segments = brute_windows(t, forms, 0.8), brute_scan(t, forms, 0.8)
        assert {x[0]: round(x[1], 12) for x in got} == {k: round(segments.get(k, d), 12) for k, d in words.items()}, t
        assert [x[0] for x in got] == sorted(words, key=lambda k: (-words[k], -segments.get(k, words[k]), k))


# --- quality ---------------------------------------------------------------------------------------------------------
def test_quality_scores(spark, awkward, nothing):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice("the sun rose over quiet hills and people went to work in the old town".split(), 40)) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice("win cash now click here free prize".split(), 40))
    y = rng.random(600) < 0.7
    docs = spark.createDataFrame([(i, good() if q else bad()) for i, q in enumerate(y)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), 0) for i, q in enumerate(y) if i % 5], "doc_id long, quality int, toxic int")
    got = quality_net.score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and sum((r.score >= 0.7) == y[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    odd = quality_net.score_documents(awkward, labels).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in quality_net.score_documents(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality_net.score_documents(nothing, labels).count() == 0


def test_context_sums_by_hand():
    s = quality_net.ContextSums()
    s.add(np.frombuffer(b"aa bb cc", np.uint8), np.array([0, 5, 8]))  # "aa bb" and " cc"
    word, shape, doc = quality_net.tokens(np.frombuffer(b"aa bb cc", np.uint8), np.array([0, 5, 8]))
    assert doc.tolist() == [0, 0, 1]
    own = s.index[0][word].astype(int) + s.index[1][shape]
    assert (s.sums[0][word[0], :-1] == own[1]).all() and (s.sums[0][word[1], :-1] == own[0]).all() and not s.sums[0][word[2], :-1].any()
