r"""Main text of web pages by boosted trees over DOM elements (operator 5).

Every element's features (dom.Page.features: tags and attribute words of its own and above it, density of its subtree,
depth, siblings, place) give a chance to belong to the article; the likeliest choice in which nothing is kept below a
dropped element decides (dom.Page.decode).  Blocks of the kept elements are joined in page order.

No page is labelled, so the model learns from pages laid out anew: `max_pages` pages, drawn by hash, give their text
blocks to a layout writer, which wraps some as article in varied ways and others as menus, headers, footers, sidebars,
notices, adverts, forms, related links and reader comments, and marks which is which.  A page's own blocks count as
article if they stand in paragraphs; the page itself teaches what its article, nav, footer, aside and form tags tell.  The
trees are fitted on the driver from a bounded number of element rows.

Defined cases: null or empty html gives the empty text; a page of any length is read whole, in time that grows with its
length whatever its markup (see dom.Tags); text without any element is kept; repeated rows are extracted each and teach
once; of equally likely choices an element is kept; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import fresh_name
from .dom import Page

MAX_PAGES, LAYOUTS = 200, 4
#: Longer pages don't teach, and no page teaches with more element rows.
MAX_CHARS, MAX_ROWS = 1 << 18, 4000


def _attrs(rng: random.Random, words: list[str]) -> str:
    """An attribute made of one of the words, as sites write them; sometimes none."""
    w = rng.choice(words)
    w = rng.choice([w, w, f"site-{w}", f"{w}-wrap", f"{w}-{rng.randint(1, 9)}", f"main {w}" if "main" not in words and rng.random() < 0.1 else f"{w} box", f"js-{w}", f"{w}Block"])
    return rng.choice([f' class="{w}"', f' class="{w}"', f' id="{w}"', f' id="{w}" class="c{rng.randint(1, 99)}"'])


def lay_out(article: list[str], others: list[str], seed: int) -> str:
    """A page with `article` as its main text and `others` around it; data-y tells what an element is."""
    rng = random.Random(seed)
    esc = html.escape
    some = lambda lo, hi: [rng.choice(others) for _ in range(rng.randint(lo, hi))]
    short = lambda t: " ".join(t.split()[:rng.randint(1, 4)])
    links = lambda n: [f'<a href="/{rng.randint(1, 999)}">{esc(short(rng.choice(others)))}</a>' for _ in range(n)]

    def link_list(n):
        ls = links(n)
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in ls) + "</ul>", " | ".join(ls), "".join(f"<div>{x}</div>" for x in ls), "<p>" + " ".join(ls) + "</p>"])

    def paragraphs(texts):
        return "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<p>{}<br>"]).format(esc(t)) for t in texts)

    def part(tags, words, inner, plain=0.3):
        tag = rng.choice(tags)
        tag = "div" if tag == "p" and "<" in inner else tag  # a paragraph ends where a block begins
        attrs = "" if tag not in ("div", "section", "p", "ul") and rng.random() < plain else _attrs(rng, words)
        return f'<{tag}{attrs} data-y="0">{inner}</{tag}>'

    menu = lambda: part(["nav", "nav", "div", "ul"], ["nav", "menu", "navbar", "breadcrumb", "navigation", "pagination"], link_list(rng.randint(3, 9)))
    head = lambda: part(["header", "header", "div"], ["header", "masthead", "topbar", "branding"], rng.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"]).format(esc(short(rng.choice(others)))) + rng.choice(["", "<p>" + esc(rng.choice(others)) + "</p>", link_list(4)]))
    foot = lambda: part(["footer", "footer", "div"], ["footer", "copyright", "legal", "colophon"], rng.choice(["&copy; {}", "<p>&copy; 2020 {}</p>", "{}"]).format(esc(rng.choice(others))) + rng.choice(["", link_list(4)]))
    side = lambda: part(["aside", "aside", "div"], ["sidebar", "side", "widget", "rail"], rng.choice([link_list(5), paragraphs(some(1, 3)), f"<h3>{esc(short(rng.choice(others)))}</h3>" + paragraphs(some(1, 2))]))
    advert = lambda: part(["div", "section", "aside", "p", "ins"], ["ad", "ads", "advert", "sponsored", "promo", "advertisement"], rng.choice([esc(rng.choice(others)), paragraphs(some(1, 2))]))
    notice = lambda: part(["div", "section", "dialog", "p"], ["cookie", "notice", "alert", "consent", "popup", "gdpr", "cookie-notice"], rng.choice([esc(rng.choice(others)), paragraphs(some(1, 2)) + "<button>OK</button>"]))
    form = lambda: part(["form", "form", "div"], ["search", "newsletter", "login", "signup", "subscribe"], f"<label>{esc(short(rng.choice(others)))}</label><input name=q><button>{esc(short(rng.choice(others)))}</button>" + rng.choice(["", paragraphs(some(1, 1))]))
    related = lambda: part(["div", "section", "aside"], ["related", "recommended", "popular", "share", "social", "tags"], rng.choice([link_list(rng.randint(2, 6)), f"<h3>{esc(short(rng.choice(others)))}</h3>" + link_list(4), paragraphs(some(1, 2))]))

    def comments():
        item = rng.choice(['<div class="comment">{}</div>', '<li class="comment">{}</li>', "<article>{}</article>", '<div class="reply">{}</div>', "<li>{}</li>", "{}"])
        pool = article if rng.random() < 0.5 else others
        inner = "".join(item.format(rng.choice(["", f"<b>{esc(short(rng.choice(others)))}</b>"]) + paragraphs([rng.choice(pool)])) for _ in range(rng.randint(1, 5)))
        return part(["section", "div", "div", "ol", "aside"], ["comments", "comment", "comment-list", "discussion", "respond", "disqus", "replies"], rng.choice(["", f"<h2>{esc(short(rng.choice(others)))}</h2>"]) + inner, 0)

    body = []
    if rng.random() < 0.7:
        title = esc(rng.choice([short(article[0]), article[0][:60]]))
        body.append(rng.choice([f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<h2>{title}</h2>", f"<h1><a href='/x'>{title}</a></h1>"]))
    at = 0
    while at < len(article):
        kind, n = rng.random(), rng.randint(1, 6)
        chunk = [esc(t) for t in article[at:at + n]]
        at += n
        if kind < 0.68:
            body.append("".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>"]).format(t) for t in chunk))
        elif kind < 0.76:
            body.append(rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{t}</li>" for t in chunk)))
        elif kind < 0.82:
            body.append("<blockquote>" + "".join(f"<p>{t}</p>" for t in chunk) + "</blockquote>")
        elif kind < 0.87:
            body.append(f"<h2>{esc(short(rng.choice(article)))}</h2>" + "".join(f"<p>{t}</p>" for t in chunk))
        elif kind < 0.91:
            body.append("<pre>" + "\n".join(chunk) + "</pre>")
        elif kind < 0.95:
            body.append("<table>" + "".join(f"<tr><td>{t}</td></tr>" for t in chunk) + "</table>")
        else:
            body.append("<section>" + "".join(f"<div>{t}</div>" for t in chunk) + "</section>")
        if rng.random() < 0.12:
            body.append(rng.choice([advert, related, side, form, notice])())
    if rng.random() < 0.25:
        body.append(rng.choice([comments, related, form])())
    inner = "".join(body)
    shell = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post-body"'),
                        ("div", ' class="entry-content"'), ("div", ' class="article-text"'), ("section", ' class="story"'), ("div", ""), ("", ""), ("td", "")])
    if shell[0] == "td":
        inner = f'<table><tr><td data-y="0">{link_list(4)}</td><td data-y="1">{inner}</td></tr></table>'
    elif shell[0]:
        inner = f'<{shell[0]}{shell[1]} data-y="1">{inner}</{shell[0]}>'
    above = "".join(x() for x in (head, menu, notice, form, advert) if rng.random() < 0.45)
    below = "".join(x() for x in (comments, related, side, form, advert, menu, foot, notice) if rng.random() < 0.4)
    whole = above + inner + below
    if rng.random() < 0.4:
        whole = rng.choice(['<div class="page">{}</div>', "<div>{}</div>", "<main>{}</main>", '<div id="wrapper"><div>{}</div></div>']).format(whole)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{whole}</body></html>"


def marked(page: Page) -> np.ndarray:
    """1 for elements of the article: the nearest mark above, and an unmarked element above any article counts as one."""
    y, own = [0] * len(page.tag), list(page.mark)
    for i in range(1, len(own)):
        if own[i] is None:
            own[i] = own[page.parent[i]]
        y[i] = 1 if own[i] is None else own[i]
    return np.array(y, np.float32)


def told(page: Page) -> np.ndarray:
    """What the page's own tags tell of its elements: 0 in nav, footer, aside and form, else 1 in article, else -1."""
    y = [-1] * len(page.tag)
    for i in range(1, len(y)):
        above, tag = y[page.parent[i]], page.tag[i]
        y[i] = 0 if above == 0 or tag in ("nav", "footer", "aside", "form") else 1 if above == 1 or tag == "article" else -1
    return np.array(y, np.float32)


def teaching_rows(source: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and marks of the elements of a page's new layouts, and of the page itself as far as its tags tell."""
    page = Page(source)
    article, others = [], []
    for block in page.blocks:
        text = " ".join("".join(t for _, t in block).split())
        tag = page.tag[block[0][0]]
        (article if tag == "p" or tag in ("h2", "h3", "blockquote", "pre") else others).append(text)
    if not article:
        return np.zeros((0, 0), np.float32), np.zeros(0, np.float32)
    others += [article[0][:80], article[-1][-60:]]
    rows = [(p.features()[1:], marked(p)[1:]) for k in range(LAYOUTS) for p in [Page(lay_out(article, others, seed + k), marked=True)]]
    y = told(page)
    rows.append((page.features()[y >= 0], y[y >= 0]))
    return np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows])


def learn(pages: DataFrame, page_html: str = "html", max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS, max_rows: int = MAX_ROWS) -> BoostedTrees:
    """Trees learned from new layouts of about `max_pages` different pages (all, if there are fewer), drawn by a hash of the
    page itself, so the same pages teach however they lie in files.  Pages over `max_chars` don't teach, and a page gives
    `max_rows` elements at most, evenly spread: what reaches the driver is bounded by these three numbers."""
    rows = pages.where(F.length(page_html).between(1, max_chars)).select(F.col(page_html).alias("body"), F.xxhash64(page_html).alias("draw"))
    n = rows.select("draw").distinct().count()
    share = min(1.0, max_pages / max(1, n))

    def run(batches):
        for batch in batches:
            for source, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = teaching_rows(source, seed)
                if len(y) > max_rows:
                    some = np.linspace(0, len(y) - 1, max_rows).astype(np.int64)
                    x, y = x[some], y[some]
                if len(y):
                    yield pa.RecordBatch.from_arrays([pa.array([seed]), pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([y.astype("<f4").tobytes()], pa.binary())], names=["seed", "x", "y"])

    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < F.lit(share * (1 << 30))).dropDuplicates(["draw"])
    got = drawn.select("body", "draw").mapInArrow(run, "seed long, x binary, y binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["seed"], r["x"]))
    if not got:
        return BoostedTrees()
    y = np.concatenate([np.frombuffer(r["y"], "<f4") for r in got])
    return BoostedTrees().fit(np.frombuffer(b"".join(r["x"] for r in got), "<f4").reshape(len(y), -1), y)


def extract(pages: DataFrame, model: BoostedTrees, page_html: str = "html", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The columns of `pages` but the html, and the main text with its code points."""
    body = fresh_name(pages.columns, "body")
    rest = [c for c in pages.columns if c != page_html]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                read = [Page(x or "") for x in part.column(part.num_columns - 1).to_pylist()]
                rows = [p.features() for p in read]
                chance = np.split(model.chance(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [p.text(p.decode(c)) for p, c in zip(read, chance, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*part.schema.names[:-1], text_col, size_col])

    schema = pages.select(*rest, F.lit("").alias(text_col), F.lit(0).cast("long").alias(size_col)).schema
    return pages.select(*rest, F.col(page_html).alias(body)).mapInArrow(run, schema)
