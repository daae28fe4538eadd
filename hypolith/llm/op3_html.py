"""HTML extraction: boosted trees over DOM nodes, and one consistent choice of nodes from top to bottom."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.boosting import Boosted
from hypolith.llm.dom import BLOCKS, Dom
from hypolith.llm.tables import table

#: Made-up pages that the trees are trained on, and their seed. Nothing of the input is used for training.
PAGES, SEED = 500, 11
_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "table", "td", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "a", "button", "body")
#: Kinds of tokens in class, id and role.
_TOKENS = (
    ("article", "content", "post", "entry", "story", "main", "text", "body", "prose"),
    ("nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "navigation", "skip", "toc"),
    ("header", "masthead", "topbar", "banner", "logo", "site"),
    ("footer", "copyright", "legal", "colophon", "contentinfo", "bottom"),
    ("sidebar", "aside", "widget", "related", "recommended", "complementary", "rail", "more", "popular", "trending"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"),
    ("cookie", "consent", "notice", "alert", "gdpr", "modal", "popup", "overlay", "warning", "message", "banner"),
    ("comment", "comments", "commentlist", "reply", "replies", "disqus", "discussion", "respond"),
    ("form", "subscribe", "newsletter", "signup", "login", "search", "share", "social", "sharing", "tags"),
)
_KIND = {w: i for i, words in enumerate(_TOKENS) for w in words}
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_OUTER = ("nav", "header", "footer", "aside", "form", "article", "main", "a", "li", "table")


def _own(tag: str, attrs: str, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """What a start tag says by itself: one-hot tag and counts of tokens by kind; and which of _OUTER it is."""
    if (held := memory.get((tag, attrs))) is None:
        own, outer = np.zeros(len(_TAGS) + len(_TOKENS), np.float32), np.zeros(len(_OUTER), np.float32)
        if tag in _TAGS:
            own[_TAGS.index(tag)] = 1
        for m in _ATTR.finditer(attrs):
            for word in re.split(r"[^a-z]+", m[1] or m[2] or m[3] or ""):
                if word in _KIND:
                    own[len(_TAGS) + _KIND[word]] += 1
        if tag in _OUTER:
            outer[_OUTER.index(tag)] = 1
        if len(memory) > 20_000:
            memory.clear()
        held = memory[tag, attrs] = own, outer
    return held


def features(dom: Dom, memory: dict) -> np.ndarray:
    """A row for each node: its tag, its attributes' and its ancestors' tokens, density of its subtree, depth and siblings."""
    n = len(dom.tag)
    parent, depth = np.array(dom.parent), np.array(dom.depth, np.float32)
    pairs = [_own(t, a, memory) for t, a in zip(dom.tag, dom.attrs, strict=True)]
    own, outer = np.stack([x for x, _ in pairs]), np.stack([x for _, x in pairs])
    above, inside = np.zeros((n, len(_TOKENS)), np.float32), np.zeros((n, len(_OUTER)), np.float32)
    chars, linked, words, stops, inner = (np.zeros(n, np.float32) for _ in range(5))
    for node, _, text in dom.texts:
        chars[node] += len(text)
        words[node] += text.count(" ")
        stops[node] += text.count(".") + text.count(",")
        if dom.links[node]:
            linked[node] += len(text)
    tags = np.ones(n, np.float32)
    for i in range(1, n):  # parents come before their children
        p = parent[i]
        above[i] = above[p] + own[p, len(_TAGS) :]
        inside[i] = np.maximum(inside[p], outer[i])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
        inner[p] += dom.tag[i] == "p"
    up = np.maximum(parent, 0)
    children = np.bincount(up[1:], minlength=n).astype(np.float32)
    first = np.zeros(n, np.float32)
    seen: dict[int, int] = {}
    for i in range(1, n):
        first[i] = seen.get(dom.parent[i], 0)
        seen[dom.parent[i]] = int(first[i]) + 1
    whole = max(1.0, float(chars[0]))
    density = lambda a, b: a / np.maximum(b, 1)
    siblings = density(chars[up] - chars, children[up] - 1)
    shape = [np.log1p(chars), density(linked, chars), density(stops, chars), density(chars, tags), density(words, chars), chars / whole, density(chars, chars[up]), np.log1p(siblings), depth, children, first, density(first, children[up]), children[up], inner, np.arange(n) / n]
    return np.concatenate([own, above, inside, np.stack(shape, 1).astype(np.float32)], 1)


def choose(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest choice of kept nodes in which every kept node's ancestors are kept too."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for i in range(len(parent) - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(len(parent), bool)
    out[0] = True
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


def main_text(dom: Dom, kept: np.ndarray) -> str:
    """The kept nodes' text: white space in a block becomes one space, blocks are joined by one newline."""
    blocks, last = [], None
    for node, block, text in dom.texts:
        if kept[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


class _Maker:
    """Random pages whose main text is known: what belongs to it carries data-y."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *of):
        return of[self.r.integers(len(of))]

    def some(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        out = []
        for i in range(int(self.r.integers(low, high + 1))):
            w = "".join(self.pick("th", "er", "on", "an", "re", "en", "de", "qu", "ié", "ch", "os", "st") for _ in range(self.r.integers(1, 5)))
            out.append((w.capitalize() if i == 0 else w) + self.pick("", "", "", "", "", ",", "."))
        return " ".join(out) + self.pick(".", ".", "", "?")

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(n))

    def boilerplate(self) -> str:
        kind = int(self.r.integers(0, 9))
        if kind == 0:
            return self.pick(f"<nav><ul>{self.links(6)}</ul></nav>", f'<div class="{self.pick("menu", "navbar", "breadcrumb", "nav main-nav")}"><ul>{self.links(5)}</ul></div>', f'<ul class="nav menu">{self.links(8)}</ul>', f'<div id="nav">{self.links(4)}</div>', f'<nav><a href="/">{self.words(1, 2)}</a></nav>', f'<div class="{self.pick("menu", "breadcrumb", "nav")}"><a href="/">{self.words(1, 2)}</a></div>')
        if kind == 1:
            return self.pick(f"<header><h1>{self.words(1, 4)}</h1><p>{self.words(2, 9)}</p></header>", f'<div class="{self.pick("header", "masthead", "site-header", "topbar")}"><a href="/">{self.words(1, 3)}</a><p>{self.words(1, 9)}</p></div>', f'<header class="site-header"><div class="logo">{self.words(1, 3)}</div><p>{self.words(3, 12)}</p></header>')
        if kind == 2:
            return self.pick(f"<footer>&copy; {self.words(2, 20)}</footer>", f"<footer><p>{self.words(2, 30)}</p><ul>{self.links(3)}</ul></footer>", f'<div class="{self.pick("footer", "copyright", "legal")}"><p>{self.words(3, 30)}</p></div>')
        if kind == 3:
            return self.pick(f"<aside><h3>{self.words(1, 4)}</h3><ul>{self.links(5)}</ul></aside>", f"<aside><p>{self.words(5, 50)}</p></aside>", f'<div class="{self.pick("sidebar", "widget", "related", "right-rail sidebar")}"><h4>{self.words(1, 4)}</h4><p>{self.words(5, 40)}</p><ul>{self.links(3)}</ul></div>')
        if kind == 4:
            body = self.pick(self.words(3, 40), f"<p>{self.words(3, 40)}</p>", f'<a href="/x">{self.words(3, 12)}</a>')
            return self.pick(f'<div class="{self.pick("ad", "ads", "advert", "sponsored", "promo", "ad-box banner-ad", "advertisement")}">{body}</div>', f'<div id="ad-{self.r.integers(99)}">{body}</div>', f'<section class="promo"><p>{self.words(5, 40)}</p></section>', f'<aside class="ad">{body}</aside>')
        if kind == 5:
            return f'<{(t := self.pick("div", "section", "aside"))} {self.pick("class", "id")}="{self.pick("cookie-notice", "cookie", "consent", "notice", "alert", "gdpr-banner", "site-notice", "popup", "modal notice")}"><p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button></{t}>'
        if kind == 6:
            one = lambda: self.pick(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></div>', f'<li class="comment"><p>{self.words(3, 60)}</p></li>', f"<article class='comment'><p>{self.words(3, 60)}</p></article>", f"<p>{self.words(3, 60)}</p>")
            body = f"<h3>{self.words(1, 3)}</h3>" * self.some(0.5) + "".join(one() for _ in range(self.r.integers(1, 6)))
            return self.pick(f'<section id="comments" class="comments">{body}</section>', f'<div class="{self.pick("comments", "comment-list", "discussion", "replies", "reader-comments")}">{body}</div>', f'<ol class="commentlist">{body}</ol>', f'<div id="comments">{body}</div>')
        if kind == 7:
            return f'<form{self.pick("", " class=newsletter", " id=search", " action=/s")}><label>{self.words(2, 12)}</label><p>{self.words(3, 20)}</p><input name="q"><select><option>{self.words(1, 2)}</option></select><button>{self.words(1, 2)}</button></form>'
        return self.pick(f'<div class="{self.pick("share", "social", "tags", "newsletter subscribe", "pagination")}">{self.words(1, 12)} <a href="/a">{self.words(1, 2)}</a></div>', f"<script>var x = '<p>{self.words(2, 5)}</p>';</script>", f"<style>p{{margin:{self.r.integers(9)}px}}</style>", f"<!-- {self.words(1, 5)} --><noscript>{self.words(3, 9)}</noscript>")

    def block(self) -> str:
        text = self.words(1, int(self.pick(3, 12, 40, 120)))
        if self.some(0.1):
            text = re.sub(" ", self.pick("### ", "%%% ", "!! ", " | ", " $$$ "), text)
        if self.some(0.3):
            text = text.replace(" ", self.pick(" <b data-y>x</b> ", ' <a data-y href="/q">link</a> ', "<br> ", " <em data-y>so</em> "), 1)
        y, kind = "data-y", int(self.r.integers(0, 14))
        if kind < 8:
            return f"<p {y}>{text}" + self.pick("</p>", "</p>", "</p>\n", "")
        if kind == 8:
            return f"<h{(k := self.r.integers(2, 5))} {y}>{self.words(1, 7)}</h{k}>"
        if kind == 9:
            return f"<ul {y}>" + "".join(f"<li {y}>{self.words(1, 20)}</li>" for _ in range(self.r.integers(1, 6))) + "</ul>"
        if kind == 10:
            return f"<blockquote {y}><p {y}>{text}</p></blockquote>"
        if kind == 11:
            return f"<table {y}>" + "".join(f"<tr {y}><td {y}>{self.words(1, 4)}</td><td {y}>{self.words(1, 4)}</td></tr>" for _ in range(self.r.integers(1, 5))) + "</table>"
        if kind == 12:
            return f"<div {y}>{text}</div>"
        return self.pick(f"<pre {y}>{text}</pre>", f"<p {y}><b {y}>{text}<br>", f"<section {y}><h2 {y}>{self.words(1, 6)}</h2><p {y}>{text}</p></section>")

    def page(self) -> str:
        out = f"<h1 data-y>{self.words(1, 9)}</h1>" * self.some(0.8)
        if self.some(0.15):
            out = f"<header data-y>{out}</header>"
        for _ in range(self.r.integers(1, int(self.pick(3, 8, 20, 40)) + 1)):
            out += self.block()
            if self.some(0.06):
                out += self.boilerplate()
        hint = self.pick("content", "post", "article-body", "entry-content", "story", "main", "page-content", "text", "prose")
        y = "data-y"
        shell = int(self.r.integers(0, 7))
        body = (f"<article {y}>{out}</article>", f"<article {y}>{out}</article>", f"<main {y}><article {y}>{out}</article></main>", f'<div {y} class="{hint}">{out}</div>', f'<main {y} id="main">{out}</main>', f'<div {y} id="{hint}"><div {y}>{out}</div></div>', f"<div {y}>{out}</div>")[shell]
        before, after = ("".join(self.boilerplate() for _ in range(self.r.integers(0, 4))) for _ in range(2))
        inner = f"{before}{body}{after}"
        if self.some(0.3):
            inner = f"<div {y} class='{self.pick('wrapper', 'container', 'page', 'site')}'>{inner}</div>"
        return f"<!DOCTYPE html><html {y}><head><meta charset='utf-8'><title>{self.words(1, 9)}</title></head><body {y}>{inner}" + "</body></html>" * self.some(0.9)


def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """Trees for 'this node belongs to the main text', from made-up pages."""
    maker, memory, x, y = _Maker(seed), {}, [], []
    for _ in range(pages):
        dom = Dom(maker.page())
        y += ["data-y" in a for a in dom.attrs]
        y[len(y) - len(dom.tag)] = True
        dom.attrs = [a.replace("data-y", "") for a in dom.attrs]
        x.append(features(dom, memory))
    return Boosted().fit(np.concatenate(x), np.array(y, float))


def extracted(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for each row of pages: the main text of the whole html.

    The trees score every node of a page; the choice is the likeliest in which no kept node lies in a dropped one.
    Null, empty and textless html gives the empty string; html without tags is one block. Rows are taken one by one,
    so repeated rows get equal results; nulls in other columns are passed on and further columns aren't read. Pages of any
    length and depth are read whole, in time that grows with their length; nodes as likely kept as dropped are dropped. No
    rows give no rows.
    """
    model = model or trained()
    where = [F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                doms = [Dom(x.as_py() or "") for x in part.column(2)]
                odds = np.split(model.scores(np.concatenate([features(d, memory) for d in doms])), np.cumsum([len(d.tag) for d in doms])[:-1])
                texts = [main_text(d, choose(d.parent, o.copy())) for d, o in zip(doms, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    found = pages.select(*where)
    return found.mapInArrow(run, f"page_id {found.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_blocks long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
