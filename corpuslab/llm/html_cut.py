"""Main text of web pages by a minimum cut.

A page becomes blocks: stretches of text between block-level tags. A logistic classifier gives each block a cost as content and one as
boilerplate; these are the capacities from the source and to the sink. Neighbouring blocks, and blocks that are close in the tree, are joined by
smoothness edges whose capacity is paid if they are labelled apart. The maximum flow leaves the blocks still reachable from the source: the content.
The classifier is trained here, on generated pages of many layouts.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import in_arrow

_NAME_OF_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose text is never read, and those whose content is not markup.
UNREAD = frozenset("head title script style noscript template svg iframe object canvas textarea select option datalist button audio video map".split())
RAW = frozenset("script style noscript textarea title template iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark math meter mfrac mi mn mo mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the same kind ends where one of these starts.
CLOSES = {k: frozenset(v.split()) for k, v in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NAV, FOOT, HEAD, SIDE, FORM, GOOD, REMARK, ADVERT, BODY, LINK, QUOTE = (1 << i for i in range(11))
TAG_FLAGS = {"nav": NAV, "menu": NAV, "footer": FOOT, "header": HEAD, "aside": SIDE, "form": FORM, "fieldset": FORM, "dialog": ADVERT, "article": BODY, "main": BODY, "a": LINK, "blockquote": QUOTE, "pre": QUOTE}
NAME_FLAGS = {
    NAV: "nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar pagination pager tabs toc skip".split(),
    FOOT: "footer foot bottom copyright legal colophon contentinfo".split(),
    HEAD: "header masthead banner logo branding".split(),
    SIDE: "sidebar aside side widget widgets related recommended recommendations complementary more trending popular".split(),
    FORM: "form search login signup signin register subscribe newsletter".split(),
    GOOD: "article content post entry story text body main articlebody maintext".split(),
    REMARK: "comment comments reply replies disqus discussion respond reader readers feedback".split(),
    ADVERT: "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay share sharing social".split(),
}
_NAME = {name: flag for flag, names in NAME_FLAGS.items() for name in names}


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    flags: int
    parent: int
    above: int
    linked: int


def _flags(attributes: str) -> int | None:
    """Flags that an element's names stand for; None if it is not shown (hidden, display: none). What aria-hidden keeps from readers' aids is shown."""
    flags = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return None
        if name in ("class", "id", "role", "itemprop"):
            for word in _WORDS.findall(value):
                flags |= _NAME.get(word.lower(), 0)
    return flags


class _Tokens:
    """A page's tags and the text between them, in time that grows with its length alone.

    A tag ends at the first `>` outside quotes. Where there is none, as a quote is not closed, the tag is passed over up to its first `>`, and the quotes that led nowhere are remembered: a later tag that comes to one of them
    outside quotes ends nowhere as well. Behind the page's last `>` all is text but for a comment.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.nowhere: set[int] = set()

    def end_of(self, pos: int) -> int:
        """Behind the `>` that ends a tag whose attributes begin at pos; -1 if none does."""
        page, tried = self.page, []
        while pos <= self.last:
            at = _STOP.search(page, pos).start()  # there is a `>` at least
            if page[at] == ">":
                return at + 1
            if at in self.nowhere:
                break
            tried.append(at)
            pos = page.find(page[at], at + 1) + 1
            if not pos:
                break
        self.nowhere.update(tried)
        return -1

    def at(self, pos: int) -> tuple[int, str, str, str, str]:
        """(end, text, slash, tag, attributes) of what begins at pos: text, or a tag with its name; all empty for a comment and for a tag that is passed over."""
        page = self.page
        if page[pos] != "<":
            end = page.find("<", pos)
            end = len(page) if end < 0 else end
            return end, page[pos:end], "", "", ""
        if page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            return (len(page) if end < 0 else end + 3), "", "", "", ""
        if pos > self.last:
            end = page.find("<!--", pos)
            end = len(page) if end < 0 else end
            return end, page[pos:end], "", "", ""
        after = page[pos + 1]
        if not (after in "!?/" or (after.isascii() and after.isalpha())):
            return pos + 1, "<", "", "", ""
        m = _NAME_OF_TAG.match(page, pos)
        if m is not None and (end := self.end_of(m.end())) >= 0:
            return end, "", m[1], m[2].lower(), page[m.end() : end - 1]
        return page.find(">", pos + 1) + 1, "", "", "", ""


class _Open:
    """The open elements of a page, outermost first: of each its tag, its flags (-1: not shown), its number, where the nearest element at or above it stands that is not inline, and where the nearest is that is no paragraph besides.

    Where the elements of each tag stand is known, so that no step looks through the open ones, however many there are.
    """

    def __init__(self) -> None:
        self.tags, self.flags, self.numbers, self.bases, self.solid = [""], [0], [0], [0], [0]
        self.where: dict[str, list[int]] = {}
        self.unread = 0

    def push(self, tag: str, flags: int, number: int) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.flags.append(flags)
        self.numbers.append(number)
        self.bases.append(self.bases[-1] if tag in INLINE else at)
        self.solid.append(self.solid[-1] if tag in INLINE or tag == "p" else at)
        self.where.setdefault(tag, []).append(at)
        self.unread += tag in UNREAD or flags < 0

    def cut(self, at: int) -> None:
        """Closes the element at a place and all inside it."""
        for tag, flags in zip(self.tags[at:], self.flags[at:], strict=True):
            self.where[tag].pop()
            self.unread -= tag in UNREAD or flags < 0
        for x in (self.tags, self.flags, self.numbers, self.bases, self.solid):
            del x[at:]

    def last(self, tag: str) -> int:
        """Where the innermost open element with a tag stands, or 0."""
        places = self.where.get(tag)
        return places[-1] if places else 0

    def ended(self, ends: frozenset[str]) -> int:
        """Where the element stands that a new one of its kind ends: the innermost of `ends`, with none but inline elements and paragraphs inside; 0 if there is none."""
        at = max(map(self.last, ends))
        return at if self.solid[-1] <= at else 0


_P = frozenset(("p",))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; text that is not read, not shown or blank gives none. Time grows with the page's length, whatever is left open or closed without being open."""
    out: list[Block] = []
    there = _Open()
    parts: list[str] = []
    number, linked, pos = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                at = there.bases[-1]
                out.append(Block(text, there.tags[at], there.flags[at], there.numbers[max(0, at - 1)], there.numbers[max(0, at - 2)], linked))
            parts.clear()
        linked = 0

    tokens = _Tokens(page)
    while pos < len(page):
        pos, piece, slash, name, attributes = tokens.at(pos)
        if not name:
            if piece and not there.unread:
                parts.append(piece)
                if there.flags[-1] & LINK:
                    linked += len(piece)
            continue
        if slash:
            at = there.last(name)
            if at:
                if name not in INLINE:
                    flush()
                there.cut(at)
            elif name == "p":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES or name in _ENDS_P:
                at = there.ended(CLOSES.get(name, _P))
                if at:
                    there.cut(at)
        if name in VOID:
            continue
        own = _flags(attributes) if len(attributes) > 2 else 0
        above = there.flags[-1]
        number += 1
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, pos)
            pos = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
            continue
        if own is None:
            there.push(name, -1, number)
            continue
        flags = max(above, 0) | TAG_FLAGS.get(name, 0) | own
        if name in ("header", "footer") and above & BODY:
            flags &= ~(HEAD if name == "header" and not above & HEAD else 0)  # an article's own head holds its title
        there.push(name, flags, number)
    flush()
    return out


_SENTENCE = re.compile(r"[.!?](?:\W|$)")
#: Words of notices; a block counts as one by their share of its words.
_NOTICE = re.compile(r"©|copyright|all rights reserved", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, 24))
    for i, b in enumerate(found):
        words, f = b.text.count(" ") + 1, b.flags
        x[i] = (
            1, min(words, 60) / 20, words < 4, min(1.0, b.linked / len(b.text)), min(3, len(_SENTENCE.findall(b.text))) / 3, b.text[-1] in ".!?…\"”»)",
            bool(f & NAV), bool(f & FOOT), bool(f & HEAD), bool(f & SIDE), bool(f & FORM), bool(f & GOOD), bool(f & REMARK), bool(f & ADVERT), bool(f & BODY), bool(f & QUOTE),
            b.tag == "p", b.tag in HEADINGS, b.tag == "li", b.tag in ("td", "th", "dt", "dd", "small", "figcaption"), b.tag == "div", min(1.0, 10 * len(_NOTICE.findall(b.text)) / words), i < 0.1 * n, i >= 0.9 * n,
        )
    return x


# ---------------------------------------------------------------- maximum flow


def content_side(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a node with gain g > 0 pays g as boilerplate, one with g < 0 pays -g as content, and an edge (i, j, c) pays c if its ends differ.

    Dinic's algorithm; nodes still reachable from the source are content.
    """
    n = len(gain)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[int] = []

    def add(a: int, b: int, c: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        left.append(c)
        head[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0)
        elif g < 0:
            add(i, t, -g, 0)
    for i, j, c in edges:
        if c > 0:
            add(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque((s,))
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(left[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if not left[e] and not cut:
                        cut = k + 1
                u = to[path[cut - 1] ^ 1]
                del path[cut - 1 :]
                continue
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if left[e] and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(head[u]):
                path.append(e)
                u = to[e]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


#: Costs are whole numbers of 1/SCALE nats; smoothness of neighbours with the same parent, the same kind of parent, or neither.
SCALE = 100
SIBLINGS, COUSINS, NEIGHBOURS, NEAREST = 90, 50, 10, 40


def smoothness(found: list[Block]) -> list[tuple[int, int, int]]:
    """Edges between neighbours, and between a block and the last one with the same parent if others stand between."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            same = a.parent == b.parent
            c = SIBLINGS if same and a.tag == b.tag else COUSINS if same or a.above == b.above else NEIGHBOURS
            if (a.flags ^ b.flags) & ~(QUOTE | LINK | GOOD | BODY):
                c = min(c, NEIGHBOURS)
            out.append((i - 1, i, c))
        j = last.get((b.parent, b.tag))
        if j is not None and j < i - 1:
            out.append((j, i, NEAREST))
        last[b.parent, b.tag] = i
    return out


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks in page order, joined by a space; empty for a null page and for one without content."""
    found = blocks(page or "")
    if not found:
        return ""
    score = features(found) @ weights
    gain = np.rint(np.clip(score, -12, 12) * SCALE).astype(int).tolist()
    return " ".join([b.text for b, c in zip(found, content_side(gain, smoothness(found)), strict=True) if c])


# ---------------------------------------------------------------- training


def generated_page(rng: random.Random) -> str:
    """A page of a random layout; each text starts with a mark of its class (U+E000 content, U+E001 boilerplate)."""
    syllables = ["an", "the", "or", "en", "ti", "ou", "re", "la", "que", "ver", "sch", "ción", "do", "mi", "ha", "st"]

    def words(a: int, b: int, end: str = ".") -> str:
        size = rng.randint(a, b)
        text = [("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))) for _ in range(size)]
        for k in range(9, size, 12):
            text[k] += "."
        if noise:
            text = [w + rng.choice(("###", "***", "%%%", "$$$")) for w in text]
        return (" ".join(text)).capitalize() + end

    noise = rng.random() < 0.15
    named = rng.random() < 0.8
    semantic = rng.random() < 0.7

    def good(a: int, b: int, end: str = ".") -> str:
        return "" + words(a, b, end)

    def bad(a: int, b: int, end: str = "") -> str:
        return "" + words(a, b, end)

    def wrap(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        place = rng.choice(("class", "id"))
        if semantic and rng.random() < 0.8:
            extra = f' {place}="{name}"' if rng.random() < 0.3 else ""
            return f"<{tag}{extra}>{inner}</{tag}>"
        return f'<div {place}="{name}">{inner}</div>' if named or tag in ("div", "form") else f"<div>{inner}</div>"

    def links(a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{bad(1, 4)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.1:
            return f"<p>{good(1, 3)}</p>"
        if kind < 0.2:
            return f"<p><b>{good(3, 12)}<br>"
        if kind < 0.27:
            return f"<h2>{good(2, 7, '')}</h2>"
        if kind < 0.33:
            return "<ul>" + "".join(f"<li>{good(3, 15, '')}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.37:
            return f"<blockquote><p>{good(8, 40)}</p></blockquote>"
        if kind < 0.41:
            return f'<p>{good(10, 40)} <a href="/y">{words(1, 3, "")}</a> {words(5, 20)}</p>'
        return f"<p>{good(12, 90)}</p>"

    def advert() -> str:
        return f'<div class="{rng.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "cookie-notice", "notice", "consent", "share", "newsletter-signup"])}">' + rng.choice((bad(3, 20, "."), f"<p>{bad(5, 40, '.')}</p>")) + "</div>"

    title = f"<h1>{good(3, 10, '')}</h1>"
    body = [paragraph() for _ in range(rng.choice((0, 1, 2, 4, 8, 15)))]
    if rng.random() < 0.3 and body:
        body.insert(rng.randrange(len(body) + 1), advert())
    inner = (f"<header>{title}</header>" if rng.random() < 0.15 else title) + "".join(body)
    holder = rng.random()
    article = f"<article>{inner}</article>" if holder < 0.5 else f"<main>{inner}</main>" if holder < 0.65 else wrap("main", ["content", "post-body", "story", "entry-content", "article-text", "articleBody"], inner)
    page = []
    if rng.random() < 0.5:
        page.append(wrap("header", ["header", "masthead", "site-header", "branding"], rng.choice((f"<h2>{bad(1, 4)}</h2>", bad(1, 5), f'<a href="/">{bad(1, 3)}</a><p>{bad(3, 8, ".")}</p>'))))
    if rng.random() < 0.85:
        page.append(wrap("nav", ["nav", "menu", "navbar", "breadcrumbs"], links(3, 9)))
    if rng.random() < 0.6:
        page.append(advert())
    page.append(article)
    if rng.random() < 0.3:
        page.append(wrap("aside", ["sidebar", "related", "widget", "side"], f"<h3>{bad(1, 4)}</h3>" + links(2, 6) + (f"<p>{bad(5, 30, '.')}</p>" if rng.random() < 0.6 else "")))
    if rng.random() < 0.3:
        page.append(f'<section {rng.choice(("class", "id"))}="{rng.choice(["comments", "comment-list", "replies", "reader-comments", "discussion"])}">' + (f"<h3>{bad(1, 3)}</h3>" if rng.random() < 0.5 else "") + "".join(f'<div class="comment"><p>{bad(4, 50, ".")}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>")
    if rng.random() < 0.3:
        page.append(f'<form action="/s"><label>{bad(1, 4)}</label><input name="q"><p>{bad(3, 15, ".")}</p></form>')
    if rng.random() < 0.2:
        page.append(advert())
    if rng.random() < 0.9:
        page.append(wrap("footer", ["footer", "copyright", "bottom", "legal"], rng.choice((f"<p>© {words(3, 12)}</p>", f"&copy; example &middot; {words(3, 12)}", links(2, 5), f"<p>{bad(4, 25, '.')}</p>"))))
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(page) + "</body></html>"


_TRAINED: dict[int, np.ndarray] = {}


def trained(pages: int = 600, seed: int = 7, steps: int = 200) -> np.ndarray:
    """Weights of the classifier, fitted on generated pages; the same for the same arguments."""
    if pages not in _TRAINED:
        rng = random.Random(seed)
        xs, ys = [], []
        for _ in range(pages):
            found = blocks(generated_page(rng))
            ys += [b.text[0] == "" for b in found]
            for b in found:
                b.text = b.text[1:] or "."
            xs.append(features(found))
        x, y = np.concatenate(xs), np.array(ys, float)
        w = np.zeros(x.shape[1])
        hessian_bound = np.linalg.norm(x.T @ x / len(x), 2) / 4 + 1e-4
        ahead = w
        for step in range(steps):
            p = 1 / (1 + np.exp(-x @ ahead))
            new = ahead - (x.T @ (p - y) / len(x) + 1e-4 * ahead) / hessian_bound
            w, ahead = new, new + step / (step + 3) * (new - w)
        _TRAINED[pages] = w
    return _TRAINED[pages]


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html): the main text and its code points.

    Null and empty pages give an empty text. Unclosed tags, comments and quotes are read to where they end or to the page's end. Repeated rows give a row
    each; further columns are ignored; an empty table gives no rows.
    """
    weights = trained() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long")
