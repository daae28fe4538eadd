"""A small DOM: nodes with parents, attributes and text, from html as it is found."""

from __future__ import annotations

import html as _html
import re
from collections import Counter

#: Elements that begin and end a block of text, elements without content, those whose content is raw text up to their end
#: tag, and those that hold nodes of which none is text of the page.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset legend details summary hr iframe center option select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("template noscript svg math object".split())
#: A start tag closes the open element of the first set, up to an element of the second.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_IN_P = BLOCKS - {"html", "body", "td", "th", "tr", "li", "dt", "dd", "option", "select", "button", "iframe", "legend", "caption", "thead", "tbody", "tfoot", "summary"}
#: A comment, a declaration or a tag. As in the tokenizer of the HTML standard a quote begins a value only right after =,
#: and an attribute's name or a value without quotes may hold any other character. A value whose quote is never closed
#: ends with its tag, so that the text after it isn't lost.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+)*+)>""", re.S)


class Dom:
    """Parallel lists over nodes in page order; node 0 is the root. texts: (node, block, text) in page order."""

    def __init__(self, html: str):
        self.tag, self.attrs, self.parent, self.depth = ["html"], [""], [-1], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.links: list[bool] = [False]
        self._read(html)

    def _read(self, html: str) -> None:
        """Every step takes time in proportion to what it opens or closes: how many elements of a name are open is counted, so that
        tags without a partner look for none. An element of HIDDEN hides what is in it if its own end tag closes it; one
        that its parent's end closes was never meant to hold the rest of the page, and hides nothing."""
        stack, block, at, n = [0], 0, 0, len(html)
        last = html.rfind(">") + 1  # no tag ends after it, so nothing is searched there
        tag, parent, depth, attrs, links = self.tag, self.parent, self.depth, self.attrs, self.links
        opened, hidden = Counter(tag), set()
        unended: set[str] = set()
        while at < n:
            m = _TAG.search(html, at, last) if at < last else None
            if piece := html[at : m.start() if m else n]:
                if not piece.isspace():
                    self.texts.append((stack[-1], block, _html.unescape(piece) if "&" in piece else piece))
                elif self.texts and self.texts[-1][1] == block:
                    self.texts.append((stack[-1], block, " "))
            if not m:
                break
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if name == "br":
                self.texts.append((stack[-1], block, " "))
            if m[1]:
                if name in VOID or name == "html" or not opened[name]:
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if tag[stack[i]] == name:
                        if any(tag[x] in BLOCKS for x in stack[i:]):
                            block += 1
                        if name in HIDDEN:
                            hidden.add(stack[i])
                        self._cut(stack, i, opened)
                        break
                continue
            if name in BLOCKS:
                block += 1
                if name in _IN_P:
                    self._close(stack, {"p"}, {"article", "section", "div", "td", "li", "table", "body"}, opened)
                if name in _CLOSES:
                    self._close(stack, *_CLOSES[name], opened)
            if name in ("html", "body") and opened[name]:
                continue
            up = stack[-1]
            tag.append(name)
            attrs.append(m[3].lower())
            parent.append(up)
            depth.append(depth[up] + 1)
            links.append(links[up] or name == "a")
            if name in OPAQUE and not m[3].endswith("/"):
                end = None if name in unended else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                unended |= set() if end else {name}
                at = end.end() if end else n
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(len(tag) - 1)
                opened[name] += 1
        if hidden:
            self._hide(hidden)

    def _cut(self, stack: list[int], i: int, opened: Counter) -> None:
        for x in stack[i:]:
            opened[self.tag[x]] -= 1
        del stack[i:]

    def _close(self, stack: list[int], names: set[str], until: set[str], opened: Counter) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in names:
                self._cut(stack, i, opened)
                return
            if self.tag[stack[i]] in until:
                return

    def _hide(self, hidden: set[int]) -> None:
        """Leaves out what lies in the hidden nodes, which stay themselves."""
        gone, place, kept = [False] * len(self.tag), [0] * len(self.tag), []
        for i in range(len(self.tag)):
            p = self.parent[i]
            gone[i] = p >= 0 and (gone[p] or p in hidden)
            if not gone[i]:
                place[i] = len(kept)
                kept.append(i)
        self.texts = [(place[node], block, text) for node, block, text in self.texts if not gone[node] and node not in hidden]
        self.parent = [-1 if self.parent[i] < 0 else place[self.parent[i]] for i in kept]
        self.tag, self.attrs, self.depth, self.links = ([x[i] for i in kept] for x in (self.tag, self.attrs, self.depth, self.links))
