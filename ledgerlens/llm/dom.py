"""A small tolerant HTML reader: elements with their text, in page order."""
from __future__ import annotations

import html as _html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "math", "title", "textarea", "xmp"))
# Elements that start a new block of text; all others run inline.
BLOCK = frozenset(("html head body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
                   "table caption thead tbody tfoot tr td th form fieldset legend figure figcaption blockquote pre address "
                   "details summary dialog hr option select button center").split())
# An open element of the second kind ends when one of the first starts inside it.
_ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "li", "dt", "dd", "option", "caption", "thead", "tbody", "tfoot"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}, "body": {"html"}}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "index", "own", "texts", "tags")

    def __init__(self, tag: str, attrs: str, parent: "Node | None", index: int):
        self.tag, self.attrs, self.parent, self.index = tag, attrs, parent, index
        self.depth = parent.depth + 1 if parent is not None else 0
        self.own = 0      # characters of text directly inside
        self.tags = 0     # inline elements inside


class Page:
    """``nodes``: block elements in page order, the root first (parents before
    children). ``blocks``: (node, text) of each block of text that has any."""

    def __init__(self, html: str | None):
        self.nodes: list[Node] = [Node("root", "", None, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.link_chars: dict[int, int] = {}
        self._buffer: list[str] = []
        self._read(html or "")

    def _flush(self, node: Node) -> None:
        if self._buffer:
            text = _SPACE.sub(" ", _html.unescape("".join(self._buffer))).strip()
            self._buffer = []
            if text:
                self.blocks.append((node.index, text))
                node.own += len(text)

    def _text(self, raw: str, node: Node, link: bool) -> None:
        if raw:
            self._buffer.append(raw)
            if link:
                self.link_chars[node.index] = self.link_chars.get(node.index, 0) + len(raw.strip())

    def _read(self, s: str) -> None:
        stack: list[tuple[str, Node]] = [("root", self.nodes[0])]     # open elements and the block each is in
        links = 0
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:], stack[-1][1], links > 0)
                break
            if lt > at:
                self._text(s[at:lt], stack[-1][1], links > 0)
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), lt):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(s, lt)
            if not m:
                if s.startswith("</", lt):          # a broken end tag, as at a cut-off page's end
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._text("<", stack[-1][1], links > 0)
                    at = lt + 1
                continue
            tag = m[2].lower()
            end = self._tag_end(s, m.end())
            attrs = s[m.end():end]
            at = min(n, end + 1)
            if m[1]:
                links = self._close(stack, tag, links)
                continue
            if end >= n and not s.endswith(">"):    # the page ends inside this tag
                break
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(s, at)
                if stop is None:
                    at = n
                else:
                    close = s.find(">", stop.end())
                    at = n if close < 0 else close + 1
                continue
            if tag in _ENDS_P:
                links = self._end_open(stack, {"p"}, {"button", "td", "th"} | (BLOCK - {"p"}), links)
            if tag in _CLOSES:
                links = self._end_open(stack, _CLOSES[tag], _SCOPE[tag], links)
            inside = stack[-1][1]
            if tag in BLOCK:
                self._flush(inside)
                if tag != "hr":
                    node = Node(tag, attrs, inside, len(self.nodes))
                    self.nodes.append(node)
                    stack.append((tag, node))
            elif tag in VOID:
                if tag in ("br", "wbr"):
                    self._buffer.append(" " if tag == "br" else "")
                inside.tags += 1
            else:
                inside.tags += 1
                if not attrs.endswith("/"):
                    stack.append((tag, inside))
                    links += tag == "a"
        self._flush(stack[-1][1])

    @staticmethod
    def _tag_end(s: str, at: int) -> int:
        """Position of the tag's ``>``, outside quotes if these are closed."""
        plain = s.find(">", at)
        if plain < 0:
            return len(s)
        i = at
        while True:
            end = s.find(">", i)
            if end < 0:
                return plain
            q = min((p for p in (s.find('"', i, end), s.find("'", i, end)) if p >= 0), default=-1)
            if q < 0:
                return end
            close = s.find(s[q], q + 1)
            if close < 0:
                return plain
            i = close + 1

    def _pop(self, stack: list[tuple[str, Node]], links: int) -> int:
        tag, node = stack.pop()
        if tag in BLOCK:
            self._flush(node)
        return links - (tag == "a")

    def _close(self, stack, tag: str, links: int) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                while len(stack) > k:
                    links = self._pop(stack, links)
                break
            if tag not in BLOCK and stack[k][0] in BLOCK:
                break         # a stray inline end tag does not end the block around it
        return links

    def _end_open(self, stack, tags: set[str], scope: set[str], links: int) -> int:
        """End the innermost open element of ``tags``, unless one of ``scope`` stands between."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    links = self._pop(stack, links)
                break
            if stack[k][0] in scope:
                break
        return links


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)}
