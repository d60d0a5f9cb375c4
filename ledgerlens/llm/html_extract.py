"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element is described by the density of its subtree (text, links,
elements), the words of its tag and attributes, depth and siblings; boosted
trees rate how likely it belongs to the article. Choices are then decoded over
the whole tree: on each way down from the root a page is first above the
article, then in it, then possibly in a part to leave out, never back; the
assignment of largest likelihood under that rule wins.

The trees are fitted on a bounded sample of the pages themselves, labelled by
their markup, together with altered copies: the article under another tag, and
menus, notices, adverts, forms, sidebars and comments put in under common names.
Labels come only from pages that name their article (an ``article`` or ``main``
element, or one by its role or itemprop); a page that does not says nothing about where it is. Where no
page of the sample names it, the densest part of each is taken for it.
"""
from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Page, attributes
from .common import small_batches, top_by_hash

#: Bound of the training sample.
SAMPLE_PAGES = 200
ALTERED = 4             # altered copies of each
#: Log odds that a part of the article is to be left out, before its node is looked at.
LEAVING = float(np.log(0.2 / 0.8))
TREES, DEPTH, RATE, BINS = 32, 5, 0.3, 32

# Tags and attribute words that are features of their own.
TAGS = ("main", "article", "section", "nav", "aside", "header", "footer", "form", "div", "p", "ul", "ol", "li", "table",
        "blockquote", "pre", "figure", "button", "select", "dialog", "address", "details")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVE = {
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "pager", "toc", "tabs"),
    "head": ("header", "masthead", "banner", "branding", "logo"),
    "foot": ("footer", "copyright", "colophon", "legal"),
    "side": ("sidebar", "aside", "rail", "widget", "related", "recommended", "popular", "trending", "teaser", "more"),
    "note": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall"),
    "ad": ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "dfp"),
    "form": ("form", "search", "login", "register", "contact"),
    "talk": ("comment", "comments", "disqus", "respond", "replies", "discussion", "reviews"),
    "share": ("share", "social", "sharing", "follow", "tags", "byline", "author"),
}
KEEP = ("article", "content", "post", "entry", "main", "story", "body", "text", "page")
FEATURES = (len(TAGS) + 1 + len(LEAVE) + 1) * 2 + 14
_WORD = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form",
          "dialog": "note", "alert": "note", "form": "form"}
_GROUP = {w: k for k, words in enumerate(LEAVE.values()) for w in words}


def _own_features(tag: str, raw: str) -> np.ndarray:
    """Tag, heading, groups of words to leave out, words to keep."""
    out = np.zeros(len(TAGS) + 1 + len(LEAVE) + 1)
    if tag in TAGS:
        out[TAGS.index(tag)] = 1
    elif tag in HEADINGS:
        out[len(TAGS)] = 1
    if raw and raw != "/":
        got = attributes(raw)
        words = set(_WORD.findall(_SPLIT.sub(" ", " ".join(got.get(k, "") for k in ("class", "id", "itemprop"))).lower()))
        at = len(TAGS) + 1
        for w in words:
            if w in _GROUP:
                out[at + _GROUP[w]] = 1
        role = got.get("role", "")
        if role in _ROLES:
            out[at + list(LEAVE).index(_ROLES[role])] = 1
        if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
            out[at + list(LEAVE).index("note")] = 1
        if words & set(KEEP) or role in ("main", "article"):
            out[-1] = 1
    return out


_CACHE: dict[tuple[str, str], np.ndarray] = {}


def node_features(page: Page) -> np.ndarray:
    """[node, feature] for the page's block elements."""
    n = len(page.nodes)
    own = np.zeros((n, FEATURES // 2 - 7))
    parent = np.array([x.parent.index if x.parent is not None else 0 for x in page.nodes])
    text = np.array([x.own for x in page.nodes], dtype=np.float64)
    tags = np.array([x.tags + 1 for x in page.nodes], dtype=np.float64)
    link = np.zeros(n)
    for i, c in page.link_chars.items():
        link[i] = c
    above = np.zeros_like(own)
    children = np.zeros(n)
    rank = np.zeros(n)
    for x in page.nodes:
        key = (x.tag, x.attrs)
        f = _CACHE.get(key)
        if f is None:
            if len(_CACHE) > 20_000:
                _CACHE.clear()
            f = _CACHE[key] = _own_features(*key)
        own[x.index] = f
        if x.parent is not None:
            p = x.parent.index
            above[x.index] = np.maximum(above[p], own[p])
            rank[x.index] = children[p]
            children[p] += 1
    sub_text, sub_tags, sub_link, blocks = text.copy(), tags.copy(), link.copy(), np.ones(n)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub_text[p] += sub_text[i]
        sub_tags[p] += sub_tags[i]
        sub_link[p] += sub_link[i]
        blocks[p] += blocks[i]
    whole = max(1.0, sub_text[0])
    siblings = children[parent]
    depth = np.array([x.depth for x in page.nodes], dtype=np.float64)
    shape = np.stack([depth, np.log1p(sub_text), np.log1p(text), sub_text / whole, sub_link / np.maximum(1, sub_text),
                      np.log1p(sub_text / sub_tags), np.log1p(blocks), np.log1p(children), np.log1p(siblings),
                      rank / np.maximum(1, siblings), np.arange(n) / n, sub_text / np.maximum(1, sub_text[parent]),
                      np.log1p(sub_text[parent]), (sub_link / np.maximum(1, sub_text))[parent]], axis=1)
    return np.concatenate([own, above, shape], axis=1)


class Boosted:
    """Gradient-boosted regression trees for the log odds, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        rate = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, w * (y - p), w * np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._leaf(tree, b)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full tree of DEPTH levels: feature and bin of each inner node (rows with a higher bin go right), leaf values."""
        inner = 2 ** DEPTH - 1
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1)
        node = np.zeros(len(b), dtype=np.int64)
        for level in range(DEPTH):
            first = 2 ** level - 1
            for k in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == k)
                if len(rows) > 1:
                    gain = 0.0
                    for f in range(b.shape[1]):
                        gs = np.cumsum(np.bincount(b[rows, f], g[rows], BINS + 1))
                        hs = np.cumsum(np.bincount(b[rows, f], h[rows], BINS + 1))
                        lam = 1.0
                        split = gs ** 2 / (hs + lam) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + lam) - gs[-1] ** 2 / (hs[-1] + lam)
                        split[(hs < 1) | (hs[-1] - hs < 1)] = 0
                        t = int(split.argmax())
                        if split[t] > gain + 1e-6:
                            gain, feature[k], limit[k] = float(split[t]), f, t
                    node[rows] = 2 * k + 1 + (b[rows, feature[k]] > limit[k])
                else:
                    node[rows] = 2 * k + 1
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1.0)
        return feature, limit, value

    @staticmethod
    def _leaf(tree, b: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        node, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[rows, feature[node]] > limit[node])
        return value[node - len(feature)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._leaf(tree, b)
        return 1 / (1 + np.exp(-score))


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """Which nodes are main text. A node above the article may have children
    above, in or out of it; one in it, in or out; one out of it, out. The choice of
    largest log likelihood is found bottom-up; ties go to leaving out."""
    n = len(p)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    above, inside, out = list(no), list(yes), list(no)
    for i in range(n - 1, 0, -1):
        q = parent[i]
        out[q] += out[i]
        inside[q] += max(inside[i], out[i] + LEAVING)
        above[q] += max(above[i], inside[i], out[i])
    state = [0] * n          # 0 above, 1 inside, 2 out
    for i in range(n):
        up = state[parent[i]] if i else 0
        if up == 2:
            state[i] = 2
        elif up == 1:
            state[i] = 1 if inside[i] > out[i] + LEAVING else 2
        else:
            top = max(above[i], out[i])
            state[i] = 1 if inside[i] > top else (2 if out[i] >= above[i] else 0)
    return np.array(state) == 1


# Markup put into altered copies.
_AROUND = ("<aside>{}</aside>", '<header class="masthead">{}</header>', '<div class="sidebar">{}</div>', '<div id="menu"><ul><li>{}</li></ul></div>',
           '<div class="cookie-notice">{}</div>', '<div role="banner">{}</div>', '<form action="/q"><label>{}</label><input></form>',
           '<div class="newsletter">{}</div>', '<section class="related"><h3>{}</h3></section>', '<header><h2>{}</h2></header>',
           '<div class="breadcrumbs">{}</div>', '<div class="footer">{}</div>', '<div class="popup" role="dialog">{}</div>')
_WITHIN = ('<div class="ad">{}</div>', '<aside class="promo"><p>{}</p></aside>', '<form><p>{}</p></form>', '<div class="share">{}</div>',
           '<section class="comments"><h3>{}</h3><p>{}</p></section>', '<div id="comments"><p>{}</p></div>',
           '<div class="notice">{}</div>', '<nav>{}</nav>')
_HOLDERS = ('<main data-y="1">', '<div class="content" data-y="1">', '<div class="post" data-y="1">', '<div id="main" data-y="1">',
            '<section data-y="1">', '<div data-y="1">', '<article class="entry" data-y="1">', '<div itemprop="articleBody" data-y="1">')
_NAMED = re.compile(r"""<(article|main)\b[^>]*>|<(\w+)\b(?=[^>]*\b(?:role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articleBody\b))[^>]*>""", re.I)


def article_span(html: str) -> tuple[int, int, int, int] | None:
    """Where a page's article stands, by the first element that names it: begin of its tag, begin and end of what is inside, end
    of its end tag. Without an end tag it goes to the end of the page; without such an element there is none."""
    found = list(_NAMED.finditer(html))
    if not found:
        return None
    m = next((x for x in found if (x[1] or "").lower() == "article"), found[0])
    depth = 1
    for x in re.finditer(rf"<(/?){re.escape(m[1] or m[2])}\b[^>]*>", html[m.end():], re.I):
        depth += -1 if x[1] else 0 if x[0].endswith("/>") else 1
        if not depth:
            return m.start(), m.end(), m.end() + x.start(), m.end() + x.end()
    return m.start(), m.end(), len(html), len(html)


def altered(html: str, rng: random.Random) -> str:
    """A copy of a page whose article stands under another element and among more things to leave out (as it is if it names none)."""
    filler = [t for _, t in Page(html).blocks] or ["More"]

    def fill(template: str) -> str:
        mark = template.replace(">", ' data-y="0">', 1)
        return re.sub(r"\{\}", lambda _: rng.choice(filler).replace("<", "&lt;"), mark)

    span = article_span(html)
    if span is None:
        return html
    start, begin, stop, end = span
    body = html[begin:stop]
    if rng.random() < 0.5:
        cuts = [x.end() for x in re.finditer(r"</p>", body)] or [len(body)]
        at = rng.choice(cuts)
        body = body[:at] + fill(rng.choice(_WITHIN)) + body[at:]
    holder = rng.choice(_HOLDERS)
    before = "".join(fill(rng.choice(_AROUND)) for _ in range(rng.randint(0, 2)))
    after = "".join(fill(rng.choice(_AROUND + _WITHIN)) for _ in range(rng.randint(0, 2)))
    return html[:start] + before + holder + body + f"</{holder[1:].split()[0]}>" + after + html[end:]


def marked(html: str) -> str | None:
    """The page with its article's element marked for ``targets``; None if the page names none."""
    span = article_span(html)
    return None if span is None else html[:span[1] - 1].rstrip("/") + ' data-y="1"' + html[span[1] - 1:]


def targets(page: Page) -> np.ndarray:
    """1 for nodes in the marked article and in none of its parts marked or known to be left out."""
    y = np.zeros(len(page.nodes))
    for x in page.nodes[1:]:
        up = y[x.parent.index]
        if 'data-y="1"' in x.attrs:
            up = 1
        if 'data-y="0"' in x.attrs or x.tag in ("nav", "aside", "footer", "form"):
            up = 0
        y[x.index] = up
    return y


def densest(page: Page) -> np.ndarray:
    """1 for nodes in the smallest element that holds most of the page's text outside links and parts known to be left out."""
    n = len(page.nodes)
    plain, left = np.zeros(n), np.zeros(n, dtype=bool)
    for x in page.nodes:
        up = x.parent is not None and left[x.parent.index]
        own = _own_features(x.tag, x.attrs)
        left[x.index] = up or x.tag in ("nav", "aside", "footer", "form", "header") or own[len(TAGS) + 1:-1].any()
        plain[x.index] = 0 if left[x.index] else max(0, x.own - page.link_chars.get(x.index, 0))
    whole = plain.copy()
    for x in reversed(page.nodes[1:]):
        whole[x.parent.index] += whole[x.index]
    at = 0
    for x in page.nodes[1:]:        # parents come before children
        if x.parent.index == at and whole[x.index] > 0.6 * whole[0]:
            at = x.index
    y = np.zeros(n)
    if whole[0]:
        for x in page.nodes:
            y[x.index] = 0 if left[x.index] else x.index == at or (x.parent is not None and y[x.parent.index])
    return y


class Model:
    def __init__(self, pages: list[str]):
        rng = random.Random(7)
        x, y, w = [], [], []

        def learn(page: Page, target: np.ndarray, weight: float) -> None:
            x.append(node_features(page))
            y.append(target)
            w.append(np.full(len(page.nodes), weight * 20.0 / len(page.nodes)))      # a page counts as one, however long it is

        named = [(html, m) for html, m in ((h, marked(h)) for h in pages) if m is not None]
        for html, mark in named:
            page = Page(mark)
            learn(page, targets(page), 2.0 * ALTERED)       # twice as much as all its altered copies
            for _ in range(ALTERED):
                page = Page(altered(html, rng))
                learn(page, targets(page), 1.0)
        for html in pages if not named else ():
            page = Page(html)
            learn(page, densest(page), 1.0)
        self.trees = Boosted(np.concatenate(x), np.concatenate(y), np.concatenate(w)) if x else None

    def extract(self, htmls: list[str | None]) -> list[str]:
        """Main text of each page."""
        pages = [Page(h) for h in htmls]
        if self.trees is None:
            return [""] * len(pages)
        p = self.trees.probability(np.concatenate([node_features(q) for q in pages])) if pages else np.zeros(0)
        out, at = [], 0
        for page in pages:
            n = len(page.nodes)
            main = decode([x.parent.index if x.parent is not None else 0 for x in page.nodes], p[at:at + n])
            at += n
            out.append("\n".join(t for i, t in page.blocks if main[i]))
        return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """Model from at most ``sample`` pages with html, by hash of the id."""
    d = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("id is not null and html is not null")
    ids = top_by_hash(d.select("id", F.lit(0).alias("g")), "g", "id", sample).select("id")
    # at most ``sample`` pages; of several under one id the first by its hash
    one = d.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("x"))
    rows = one.select("id", "x.html").collect()
    return Model([r.html for r in sorted(rows, key=lambda r: r.id)])


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with ``text_col`` added.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by a line break. Null, empty and
    text-less pages give an empty string, and so does every page when there was
    none to learn from. Equal pages give equal texts; broken or cut-off markup is
    read as far as it goes."""
    @F.pandas_udf("string")
    def of(htmls: pd.Series) -> pd.Series:
        todo = [h if isinstance(h, str) else None for h in htmls]
        return pd.Series([t for a in range(0, len(todo), 256) for t in model.extract(todo[a:a + 256])], dtype=object)

    return small_batches(pages).withColumn(text_col, of(F.col(html_col)))
