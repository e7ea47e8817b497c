"""A small HTML reader for main-text extraction: elements that can be kept or dropped, the text blocks between them, and
features of every such element.

Elements are block-level tags and any tag with a class, id or role.  Comments, scripts, styles, titles and other parts that
are never shown are skipped up to their end tag; one that never ends costs only its tag (scripts and styles: the rest).  A block is the text between two block boundaries; each of its pieces knows the element
it stands in.  Text in no element at all belongs to the root.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import numpy as np

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)|<!--|<[!?]")
SPECIAL = re.compile("[>\"']")
#: Tags whose quotes don't close that a page may have before its tag ends are looked up in a table.
FAILED = 8
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|data-y)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template iframe svg object title textarea select option button audio video canvas annotation annotation-xml".split())
#: Unseen to the end of the page, if nothing ends them; of any other unseen element without an end only the tag goes.
TO_END = frozenset(["script", "style"])
#: Elements of SVG and MathML may close themselves.
FOREIGN = frozenset(["svg", "math", "annotation", "annotation-xml"])
#: What can stand in the head; any other tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
ENDS_P = BLOCK - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these kinds, up to the nearest of the second set.
CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
          "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
          "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"]))}
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I | re.A) for t in UNSEEN}
#: An option ends with its end tag, or before the next option, the end of its list, or a block.
END["option"] = re.compile(rf"</option(?=[\s/>])[^>]*>?|(?=</?(?:option|optgroup|select|datalist|{'|'.join(sorted(BLOCK))})[\s/>])", re.I | re.A)
#: Attribute words by what they tell about an element.
WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager skip tabs",
    "head": "header masthead top topbar logo branding banner",
    "foot": "footer bottom copyright colophon legal",
    "side": "sidebar aside side rail widget widgets secondary complementary",
    "ad": "ad ads advert adverts advertisement adsense adslot sponsor sponsored promo promoted promotion",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay message warning paywall announcement",
    "form": "form search login signin signup newsletter subscribe subscription register contact",
    "comment": "comment comments reply replies respond disqus discussion reader feedback commentlist",
    "share": "share sharing social follow facebook twitter like",
    "related": "related recommended recommendations popular trending also teaser teasers",
    "main": "article content main post entry story body text",
    "meta": "byline author date meta tag tags category credit",
    "hidden": "hidden none offscreen",
}
GROUP = {w: i for i, ws in enumerate(WORDS.values()) for w in ws.split()}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td",
        "blockquote", "pre", "figure", "label", "body", "dl", "span", "a"]
TAG_AT = {t: i for i, t in enumerate(TAGS)}
ABOVE = ["article", "main", "nav", "header", "footer", "aside", "form", "li", "table"]
ABOVE_AT = {t: i for i, t in enumerate(ABOVE)}
NUMBERS = 17
N_FEATURES = len(TAGS) + 1 + len(ABOVE) + 2 * len(WORDS) + NUMBERS


class Tags:
    """The tags of a source one after another: (start, end, name, whether it closes, attributes); a name is None for comments and
    declarations.  A tag ends at the first `>` outside quotes, or at the first of all if its quotes don't close.

    The work is linear whatever the source: beyond the last `>` nothing can be a tag, so none is looked for there, and a page
    on which quotes again and again don't close (each such tag is read to the end in vain) gets a table of where tags end."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">") + 1
        self.failed, self.table = 0, None

    def after(self, pos: int):
        if pos >= self.last:
            return self.comment_at_the_end(pos)
        if self.failed > FAILED:
            return self.looked_up(pos)
        m = TAG.search(self.source, pos, self.last)
        if not m:
            return self.comment_at_the_end(pos)
        if m[5]:
            self.failed += 1
            return m.start(), m.end(), m[5], m[4], m[6]
        end = len(self.source) if m.end() == self.last and self.source.startswith("<!--", m.start()) and not self.source.endswith("-->", m.start() + 4, self.last) else m.end()
        return m.start(), end, m[2], m[1], m[3] or ""

    def comment_at_the_end(self, pos: int):
        at = self.source.find("<!--", max(pos, self.last))
        return None if at < 0 else (at, len(self.source), None, "", "")

    def looked_up(self, pos: int):
        if self.table is None:
            self.fill()
        m = OPEN.search(self.source, pos, self.last)
        if not m:
            return self.comment_at_the_end(pos)
        if m[2] is None:
            if m[0] == "<!--":
                end = self.source.find("-->", m.end())
                return m.start(), len(self.source) if end < 0 else end + 3, None, "", ""
            return m.start(), self.source.find(">", m.end()) + 1, None, "", ""
        k = bisect.bisect_left(self.at, m.end())
        end = self.table[k] if k < len(self.at) and self.table[k] >= 0 else self.source.find(">", m.end())
        return m.start(), end + 1, m[2], m[1], self.source[m.end():end]

    def fill(self) -> None:
        """For every `>` and quote, where the first `>` outside quotes is if none is open there (-1: nowhere)."""
        self.at = [m.start() for m in SPECIAL.finditer(self.source)]
        self.table = [-1] * (len(self.at) + 1)
        quote = {'"': len(self.at), "'": len(self.at)}  # the next quote of each kind
        for k in range(len(self.at) - 1, -1, -1):
            c = self.source[self.at[k]]
            if c == ">":
                self.table[k] = self.at[k]
            else:
                self.table[k] = self.table[quote[c] + 1] if quote[c] < len(self.at) else -1
                quote[c] = k


class Page:
    """Elements of a page (root first, parents before children) and its blocks: lists of (element, text).  `marked`: the
    page was written by main_text.lay_out, whose data-y attributes are its marks; any other page's mean nothing here."""

    def __init__(self, source: str, marked: bool = False):
        self.marked = marked
        self.tag, self.parent, self.groups, self.mark = ["html"], [-1], [0], [None]
        self.blocks: list[list[tuple[int, str]]] = []
        self.links: list[int] = [0]
        self.read(source)

    def read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open tags, each with the element its content belongs to
        count = {"html": 1}
        run: list[tuple[int, str]] = []
        at, in_head, endless = 0, False, set()

        def flush():
            nonlocal run
            if any(not t.isspace() for _, t in run):
                self.blocks.append(run)
            run = []

        def pop(to: int):
            while len(stack) > to:
                tag = stack.pop()[0]
                count[tag] -= 1
                if tag in BLOCK:
                    flush()

        def close_until(kinds, stop):
            if not any(count.get(k) for k in kinds):
                return None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in kinds:
                    return pop(i)
                if stack[i][0] in stop:
                    return None

        pos, end, tags = 0, len(source), Tags(source)
        while pos < end:
            m = tags.after(pos)
            at = m[0] if m else end
            if at > pos and not (in_head and source[pos:at].isspace()):
                in_head = False
                text = source[pos:at]
                text = html.unescape(text) if "&" in text else text
                owner = stack[-1][1]
                run.append((owner, text))
                if count.get("a"):
                    self.links[owner] += len(text.split()) and len(text)
            if not m:
                break
            _, pos, name, closing, attrs = m
            if not name:
                continue
            tag = name.lower()
            in_head = in_head and tag in IN_HEAD
            if closing:
                if tag == "br":
                    run.append((stack[-1][1], " "))
                elif count.get(tag) and tag not in ("html", "body"):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            pop(i)
                            break
                continue
            if tag in VOID:
                if tag == "br":
                    run.append((stack[-1][1], "\n"))
                elif tag == "hr":
                    flush()
                continue
            if tag in UNSEEN:
                if tag in FOREIGN and attrs.endswith("/"):
                    continue
                ended = None if tag in endless else END[tag].search(source, pos)
                if ended:
                    pos = ended.end()
                else:
                    endless.add(tag)
                    pos = end if tag in TO_END else pos
                continue
            if tag == "head":
                in_head = True
                continue
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            if tag in ("html", "body"):
                continue
            if tag in ENDS_P and count.get("p"):
                close_until(("p",), ())
            if tag in CLOSES:
                close_until(*CLOSES[tag])
            is_block = tag in BLOCK
            if is_block:
                flush()
            owner = stack[-1][1]
            found, mark = 0, None
            if attrs and "=" in attrs or "hidden" in attrs:
                for a in ATTR.finditer(attrs):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key == "data-y":
                        mark = int(value) if self.marked else None
                    elif key == "style":
                        found |= (re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None) << GROUP["hidden"]
                    elif key == "hidden" or key == "aria-hidden":
                        found |= (value.lower() != "false") << GROUP["hidden"]
                    else:
                        for w in TOKEN.findall(value):
                            g = GROUP.get(w.lower())
                            if g is not None:
                                found |= 1 << g
                        found |= 1 << 30
            if is_block or found:
                self.tag.append(tag)
                self.parent.append(owner)
                self.groups.append(found & ~(1 << 30))
                self.mark.append(mark)
                self.links.append(0)
                owner = len(self.tag) - 1
            stack.append((tag, owner))
            count[tag] = count.get(tag, 0) + 1
        flush()

    def features(self) -> np.ndarray:
        """One row per element: tag, tags and attribute words above and of its own, text and link density of its subtree,
        depth, siblings, place in the page."""
        n = len(self.tag)
        chars, words, stops, blocks, first = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
        total = 0
        for block in self.blocks:
            for i, text in block:
                if first[i] < 0:
                    first[i] = total
                chars[i] += len(text)
                words[i] += text.count(" ") + 1
                stops[i] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                total += len(text)
            blocks[block[0][0]] += 1
        links, tags, kids = list(self.links), [1] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            words[p] += words[i]
            stops[p] += stops[i]
            blocks[p] += blocks[i]
            links[p] += links[i]
            tags[p] += tags[i]
            kids[p] += 1
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        depth, above, above_words = [0] * n, [0] * n, [0] * n
        kid_chars, order, same = [0] * n, [0] * n, {}
        seen = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            k = ABOVE_AT.get(self.tag[p])
            above[i] = above[p] | (0 if k is None else 1 << k)
            above_words[i] = above_words[p] | self.groups[p]
            kid_chars[p] += chars[i]
            order[i] = seen[p]
            seen[p] += 1
            same[p, self.tag[i]] = same.get((p, self.tag[i]), 0) + 1
        out = np.zeros((n, N_FEATURES), np.float32)
        a, b, c = len(TAGS) + 1, len(TAGS) + 1 + len(ABOVE), len(WORDS)
        out[np.arange(n), [TAG_AT.get(t, len(TAGS)) for t in self.tag]] = 1
        bits = lambda x, k: (np.array(x, np.int64)[:, None] >> np.arange(k)) & 1
        out[:, a:b] = bits(above, len(ABOVE))
        out[:, b:b + c] = bits(self.groups, c)
        out[:, b + c:b + 2 * c] = bits(above_words, c)
        log = math.log1p
        total = total or 1
        out[:, b + 2 * c:] = [
            (log(ch), log(w), li / (ch or 1), st / (w or 1), ch / tg, ch / (bl or 1), ch / (w or 1), dp, log(kd), log(kids[p] if i else 0), od / ((kids[p] if i else 0) or 1),
             log(kid_chars[p] / (kids[p] or 1) if i else 0), same.get((p, tag), 1) / (kids[p] or 1) if i else 1, fi / total, ch / total, bl, ch / ((chars[p] if i else 0) or 1))
            for i, (ch, w, li, st, tg, bl, dp, kd, p, od, fi, tag) in enumerate(zip(chars, words, links, stops, tags, blocks, depth, kids, self.parent, order, first, self.tag, strict=True))]
        return out

    def decode(self, p: np.ndarray) -> list[bool]:
        """The likeliest choice in which nothing is kept below a dropped element; p: chance of each to be kept."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
        for i in range(n - 1, 0, -1):
            q = self.parent[i]
            yes[q] += max(yes[i], no[i])
            no[q] += no[i]
        keep = [True] * n  # the root holds whatever is kept
        for i in range(1, n):
            keep[i] = keep[self.parent[i]] and yes[i] > no[i]
        return keep

    def text(self, keep: list[bool]) -> str:
        out = (" ".join("".join(t for i, t in block if keep[i]).split()) for block in self.blocks)
        return "\n\n".join(t for t in out if t)
