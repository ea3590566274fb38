"""Main text of web pages by a tree-structured graphical model over the DOM.

Each DOM node is content or not. A node's own evidence (tag, words of class, id and
role, link share, length, punctuation) gives a potential, and parent and child are
joined by a pairwise potential that depends on the child's kind of tag. Sum-product
messages go once from the leaves to the root and once back, which gives each node's
marginal. Potentials are counted on labelled pages (``training_pages``), smoothed.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import as_bytes, chunks

# Fixed values of the HTML standard: void elements, elements with raw text, block elements and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "tbody", "thead", "p"]), "tfoot": frozenset(["tr", "td", "th", "tbody", "thead", "p"]), "body": frozenset(["head"]),
}
#: An end of one of these isn't looked for beyond a cell, and a start tag closes nothing beyond these.
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
_WALL = frozenset("body html table td th div section article aside nav main header footer form ul ol dl blockquote".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name: attributes up to ">", which may stand inside quotes.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Words of class, id and role that tell what an element is for.
CUES = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager sitemap tabs skip toolbar",
    "head": "header head masthead banner top logo branding hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "aside sidebar side widget widgets rail related recommended recommendations more trending popular teaser teasers",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner outbrain taboola dfp",
    "comment": "comment comments commentlist disqus discussion replies reply respond reader readers responses",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall message toast",
    "form": "form search login signin register contact",
    "share": "share sharing social follow meta byline tags tag author",
    "content": "article content post entry story text body main maintext prose blog articlebody",
}
_CUE = defaultdict(list)
for _k, _v in CUES.items():
    for _w in _v.split():
        _CUE[_w].append(_k)


class Page:
    """A parsed page: nodes in document order, and its text runs with their nodes and blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attr = ["#root"], [-1], [""]
        self.runs: list[tuple[int, int, str]] = []  # node, block number, text
        self._parse(source)

    def _tags(self, s: str) -> Iterator[tuple[int, int, str, str, str]]:
        """Start, end, slash, name and attributes of each tag; name is empty for comments and declarations.

        Every character is looked at a bounded number of times: where a quote is never
        closed, tags end at their first ">" from there on.
        """
        at, last, quotes = 0, s.rfind(">"), True
        while (start := s.find("<", at)) >= 0:
            if s.startswith("<!--", start):
                end = s.find("-->", start + 4)
                end = len(s) if end < 0 else end + 3
                yield start, end, "", "", ""
            elif start > last:
                return
            elif s[start + 1] in "!?":
                end = s.index(">", start) + 1
                yield start, end, "", "", ""
            elif m := _NAME.match(s, start + 1):
                rest = _REST.match(s, m.end()) if quotes else None
                if rest is None:
                    quotes, end = False, s.index(">", start) + 1
                    yield start, end, m[1], m[2], s[m.end() : end - 1]
                else:
                    end = rest.end()
                    yield start, end, m[1], m[2], rest[1]
            else:
                at = start + 1
                continue
            at = end
            if self._skip > at:
                at = self._skip

    def _parse(self, s: str) -> None:
        stack, block, at, self._skip = [0], 0, 0, 0
        where: dict[str, list[int]] = defaultdict(list)  # places on the stack of each open tag
        top = lambda tags: max((where[t][-1] for t in tags if where.get(t)), default=0)

        def pop_to(k: int) -> None:
            while len(stack) > k:
                where[self.tag[stack.pop()]].pop()

        for start, end, slash, tag, attrs in self._tags(s):
            if start > at:
                self.runs.append((stack[-1], block, html_lib.unescape(s[at:start])))
            at = end
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                k = top((tag,))
                if k and not (tag in INLINE and top(_WALL) > k):
                    pop_to(k)
                block += tag in BLOCK
                continue
            if shut := CLOSES.get(tag):
                wall = top(SCOPE.get(tag, _WALL) - shut)
                if tag in SCOPE:
                    firsts = [where[t][i] for t in shut if where.get(t) and (i := bisect_right(where[t], wall)) < len(where[t])]
                    pop_to(min(firsts, default=len(stack)))
                elif (k := top(shut)) > wall:
                    pop_to(k)
            block += tag in BLOCK
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.attr.append(attrs if attrs and not attrs.isspace() else "")
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(s, at)
                if tag == "textarea":
                    self.runs.append((node, block, ""))
                at = self._skip = close.end() if close else len(s)
            elif tag == "br":
                self.runs.append((stack[-1], block, " "))
            elif tag not in VOID and not attrs.endswith("/"):
                where[tag].append(len(stack))
                stack.append(node)
        if at < len(s):
            self.runs.append((stack[-1], block, html_lib.unescape(s[at:])))

    def features(self) -> list[tuple]:
        """Per node: tag, cues of its attributes, link share, length and punctuation classes."""
        n = len(self.tag)
        chars, links, stops = np.zeros(n), np.zeros(n), np.zeros(n)
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for node, _, text in self.runs:
            size = len(text) - text.count(" ")
            chars[node] += size
            links[node] += size * in_link[node]
            stops[node] += text.count(".") + text.count(",")
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            stops[p] += stops[i]
        share = np.where(chars > 0, np.minimum(3, (4 * links / np.maximum(chars, 1)).astype(int)), 4)
        size = np.minimum(5, np.log2(chars / 10 + 1).astype(int))
        stop = np.minimum(3, (stops / np.maximum(chars, 1) * 100).astype(int))
        return [(t, _cues(a), int(x), int(y), int(z)) for t, a, x, y, z in zip(self.tag, self.attr, share, size, stop, strict=True)]


@lru_cache(maxsize=50_000)
def _cues(attrs: str) -> tuple[str, ...]:
    out = set()
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        value = value.strip("\"'")
        if name in ("class", "id", "role"):
            for w in _PARTS.findall(value):
                out.update(_CUE.get(w.lower(), ()))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.add("hidden")
    return tuple(sorted(out))


def _kind(tag: str) -> str:
    return tag if tag in ("article", "main", "nav", "header", "footer", "aside", "form", "script", "style", "a", "button") else "inline" if tag in INLINE else "block" if tag in BLOCK else "other"


class Model:
    """Potentials from labelled pages: (page, labels of its nodes) pairs."""

    def __init__(self, pages: list[tuple[Page, list[int]]], smooth: float = 0.5):
        own: dict = defaultdict(lambda: np.full(2, smooth))
        pair: dict = defaultdict(lambda: np.full((2, 2), smooth))
        total = np.full(2, smooth)
        for page, y in pages:
            for i, f in enumerate(page.features()):
                total[y[i]] += 1
                for key in self._keys(f):
                    own[key][y[i]] += 1
                if i:
                    pair[_kind(page.tag[i])][y[page.parent[i]], y[i]] += 1
        rate = total / total.sum()
        self.own = {k: np.log(v / v.sum()) - np.log(rate) for k, v in own.items()}
        self.pair = {k: v / v.sum(axis=1, keepdims=True) for k, v in pair.items()}
        self.any_pair = sum(self.pair.values()) / len(self.pair)
        self._known: dict = {}

    @staticmethod
    def _keys(f: tuple) -> list[tuple]:
        tag, cues, links, size, stops = f
        return [("tag", tag), *[("cue", c) for c in cues], ("links", _kind(tag), links), ("size", _kind(tag), size), ("stops", stops)]

    def evidence(self, f: tuple) -> np.ndarray:
        got = self._known.get(f)
        if got is None:
            logs = np.zeros(2)
            for key in self._keys(f):
                x = self.own.get(key)
                if x is not None:
                    logs += x * (1.0 if key[0] in ("tag", "cue") else 0.5)
            logs = np.exp(np.clip(logs - logs.max(), -30, 0))
            if len(self._known) > 100_000:
                self._known.clear()
            got = self._known[f] = logs
        return got

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node by one upward and one downward sweep of messages."""
        n = len(page.tag)
        feats = page.features()
        pairs = [self.pair.get(_kind(t), self.any_pair) for t in page.tag]
        b0, b1 = [0.0] * n, [0.0] * n
        for i, f in enumerate(feats):
            b0[i], b1[i] = self.evidence(f)
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            q, p = pairs[i], page.parent[i]
            m0 = q[0, 0] * b0[i] + q[0, 1] * b1[i]
            m1 = q[1, 0] * b0[i] + q[1, 1] * b1[i]
            s = m0 + m1
            up0[i], up1[i] = m0 / s, m1 / s
            x0, x1 = b0[p] * up0[i], b1[p] * up1[i]
            s = x0 + x1
            b0[p], b1[p] = x0 / s, x1 / s
        out = [0.0] * n
        out[0] = b1[0] / (b0[0] + b1[0])
        for i in range(1, n):
            q, p = pairs[i], page.parent[i]
            # The parent's belief without what this child told it.
            x1 = out[p] / max(up1[i], 1e-300)
            x0 = (1 - out[p]) / max(up0[i], 1e-300)
            m0, m1 = x0 * q[0, 0] + x1 * q[1, 0], x0 * q[0, 1] + x1 * q[1, 1]
            y0, y1 = b0[i] * m0, b1[i] * m1
            out[i] = y1 / (y0 + y1) if y0 + y1 > 0 else 0.0
        return out


def training_pages(n: int = 400, seed: int = 11) -> list[tuple[Page, list[int]]]:
    """Labelled pages made by rule: layouts of common sites whose content elements carry data-main.

    An element is content when it or an ancestor carries data-main="1" and no nearer one data-main="0".
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ti", "ron", "e", "sal", "um", "ver", "o", "lin", "ta")) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(5, 18).capitalize() + r.choice((".", ".", ".", "?", ", " + words(3, 6) + "."))
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))
    name = lambda *c: r.choice((f'class="{r.choice(c)}"', f'id="{r.choice(c)}"', f'class="{word()} {r.choice(c)}"'))
    off = 'data-main="0"'

    def inner() -> str:
        out = [f"<h1>{words(3, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 9)):
            x = r.random()
            text = words(1, 4).capitalize() + "." if r.random() < 0.25 else prose()
            if r.random() < 0.35:
                text = text.replace(" ", f" <{(t := r.choice(('b', 'em', 'a href=/x', 'i', 'strong', 'span')))}>" + word() + f"</{t.split()[0]}> ", 1)
            if x < 0.68:
                out.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>")))
            elif x < 0.78:
                out.append(f"<h{r.choice('23')}>{words(2, 6)}</h{r.choice('23')}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"<pre><code>{words(4, 12)}</code></pre>")
            if r.random() < 0.08:
                out.append(r.choice((f'<div {off} {name("ad", "ads", "advert", "sponsored", "promo")}>{prose(1, 2)}</div>', f'<aside {off}>{prose(1, 2)}</aside>', f'<div {off} {name("share", "social", "related")}><ul>{links(2, 4)}</ul></div>', f'<div {off} {name("newsletter", "subscribe")}><form {off}>{sentence()}<input><button>{word()}</button></form></div>')))
        return "".join(out)

    def page() -> str:
        main = inner()
        main = r.choice((
            f'<article data-main="1">{main}</article>', f'<article data-main="1" {name("post", "entry", "story")}>{main}</article>', f'<main><article data-main="1">{main}</article></main>', f'<main data-main="1">{main}</main>',
            f'<div data-main="1" {name("content", "article", "post", "entry-content", "article-body", "main")}>{main}</div>', f'<div {name("wrapper", "container", "page")}><div data-main="1" {name("content", "article-body", "story")}>{main}</div></div>',
            f'<section data-main="1" {name("content", "article")}>{main}</section>',
        ))
        before = [
            f"<nav><ul>{links(3, 9)}</ul></nav>", f'<div {name("nav", "menu", "navbar", "breadcrumbs")}><ul>{links(2, 8)}</ul></div>', f'<header><h1>{words(1, 3)}</h1><p>{words(2, 6)}</p></header>', f'<div {name("header", "masthead", "banner")}>{words(2, 5)}</div>',
            f'<div {name("ad", "ads", "advert", "sponsored")}>{prose(1, 2)}</div>', f'<div {name("cookie-notice", "cookie", "consent", "notice", "alert")}><p>{prose(1, 3)}</p><button>{word()}</button></div>', f'<form action="/s" {name("search", "login")}><label>{words(1, 3)}</label><input><button>{word()}</button></form>',
            f"<aside>{prose(1, 3)}</aside>", f'<noscript>{sentence()}</noscript>', f'<div {name("hidden-x")} style="display:none">{prose(1, 2)}</div>',
        ]
        after = [
            f"<footer>&copy; {words(1, 3)} &middot; {prose(1, 3)}</footer>", f"<footer><p>{prose(1, 2)}</p><ul>{links(2, 6)}</ul></footer>", f'<div {name("footer", "legal", "copyright")}>{prose(1, 2)}</div>', f'<aside {name("sidebar", "related", "widget")}><h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul></aside>',
            f'<div {name("sidebar", "related", "widget", "popular")}><h3>{words(1, 3)}</h3><ul>{links(2, 7)}</ul><p>{prose(1, 2)}</p></div>',
            f'<section {name("comments", "discussion", "disqus", "comment-list")}><h3>{words(1, 2)}</h3>' + "".join(f'<div {name("comment", "reply")}><b>{word()}</b><p>{prose(1, 3)}</p></div>' for _ in range(r.randint(1, 5))) + f'<form {name("respond")}><textarea></textarea></form></section>',
            f'<div {name("comments", "comment-list")}><ol>' + "".join(f'<li {name("comment")}><p>{prose(1, 3)}</p></li>' for _ in range(r.randint(1, 5))) + "</ol></div>", f'<form {name("newsletter", "subscribe", "contact")}><p>{sentence()}</p><input><button>{word()}</button></form>', f'<div {name("ad", "promo", "sponsored")}>{prose(1, 2)}</div>',
        ]
        body = "".join(r.sample(before, r.randint(1, 4))) + main + "".join(r.sample(after, r.randint(1, 4)))
        if r.random() < 0.3:
            body = f'<div {name("wrapper", "container", "page", "layout")}>{body}</div>'
        return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 6)}</title><style>p{{}}</style><script>x('</p>')</script></head><body>{body}</body></html>"

    out = []
    for _ in range(n):
        p = Page(page())
        y = [0] * len(p.tag)
        for i in range(1, len(p.tag)):
            m = re.search(r'data-main="([01])"', p.attr[i])
            y[i] = int(m[1]) if m else y[p.parent[i]]
            p.attr[i] = re.sub(r'data-main="[01]"', "", p.attr[i])
        out.append((p, y))
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    return Model(training_pages())


def main_text(source: str, model: Model | None = None) -> str:
    """The text of the content nodes: blocks in page order, one per line, white space folded."""
    page = Page(source)
    p = (model or trained()).marginals(page)
    out, last, parts = [], None, []
    for node, block, text in [*page.runs, (0, -1, "")]:
        if block != last:
            line = _SPACES.sub(" ", "".join(parts)).strip()
            if line:
                out.append(line)
            parts, last = [], block
        if p[node] > 0.5:
            parts.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html).

    Null html is empty and gives an empty text, as do pages without content nodes. Null ids
    and urls and repeated rows stay; further columns are dropped; an empty table gives no
    rows. Pages are read whole. The model is trained in each worker from the same labelled pages.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for b in chunks(batches, "html", rows_at_once=512):
            text = [main_text(t.decode("utf-8", "replace"), model) if t else "" for t in as_bytes(b, "html")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(emit, "page_id long, url string, text string, n_chars long")
