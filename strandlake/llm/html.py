"""Main text of web pages by a tree-structured graphical model over DOM nodes.

A page is parsed into elements; a node is an element that holds text, itself or below. Each node is content or
boilerplate. Its own potential comes from a log-linear model over features (tag, words of class and id, text and link
density, depth, punctuation, the page's place), and a potential couples each child with its parent: content within
content is likely, content within boilerplate is not. Sum-product messages go from the leaves to the root and back, and
a text is kept if the content marginal of the element it stands in is at least one half. The parameters are fitted by
gradient ascent on the likelihood of labelled pages (`labelled_pages`, made by rule, with the label of every text),
where the gradient's expectations come from the same message passing.

Text of elements that never hold content (scripts, styles, forms, navigation and the like, FIXED below) is clamped to
boilerplate, a rule of the markup itself rather than a learned one. Character references are decoded, white space within
a block becomes one space, and blocks, which block-level elements part (a line break is white space), are joined in
page order by two line feeds.

Defined results: null or empty html, and a page without content, give an empty text; unclosed and misnested tags are
closed as their parents close; pages that repeat are rows of the result each; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ship

#: Element names by their role in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FIXED = frozenset("head script style template noscript form nav aside footer menu dialog button select option textarea iframe object svg canvas audio video map title noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em i ins kbd mark q s samp small span strong sub sup time u var".split())
#: An open element of the first kind ends where one of the second kind begins.
CLOSED_BY = {
    "p": BLOCK,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option"}),
}
#: A tag's end does not reach beyond the nearest of these around it.
FENCE = frozenset("table td th article section main aside nav footer header div body html ul ol".split())
PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>", re.S)
#: An attribute: its name, then its value in quotes or without (an open quote runs to the tag's end).
ATTRIBUTES = re.compile(r"([^\s/][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"']\S*)))?")
READ = frozenset("class id role hidden style itemprop".split())
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

#: Words of class, id and role that publishers use for parts of a page.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notification overlay paywall pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar warning widget".split())
CONTENT = frozenset("article articlebody body blog content entry main maincontent post story text".split())


class Node:
    __slots__ = ("tag", "parent", "names", "texts", "depth", "chars", "links", "children", "fixed", "hidden", "stops")

    def __init__(self, tag: str, parent: "int", names: frozenset, depth: int, fixed: bool):
        self.tag, self.parent, self.names, self.depth, self.fixed = tag, parent, names, depth, fixed
        self.chars = self.links = self.children = self.stops = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, int, str]]]:
    """The page's elements, parents first, and its texts: (element, number of its block, decoded text)."""
    nodes = [Node("#page", -1, frozenset(), 0, False)]
    texts: list[tuple[int, int, str]] = []
    stack, block, at, n = [0], 0, 0, len(page)
    # Where in the stack each tag is open, and where fences are, so that no end tag has to walk through the stack.
    places: dict[str, list[int]] = {}
    fences: list[int] = []

    def close_from(k: int) -> None:
        while len(stack) > k:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            if tag in FENCE:
                fences.pop()

    def open_at(tag: str, through: bool) -> int | None:
        """The nearest open element of that tag; with a fence before it only if the tag may reach through."""
        if not places.get(tag):
            return None
        k = places[tag][-1]
        return k if through or not fences or fences[-1] <= k else None

    def say(text: str) -> None:
        if text and not text.isspace():
            texts.append((stack[-1], block, entities.unescape(text)))
        elif text:
            texts.append((stack[-1], block, " "))

    while at < n:
        m = PARTS.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:-3]))
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCK:
                block += 1
            if (k := open_at(tag, tag in FENCE)) is not None:
                close_from(k)
            continue
        while len(stack) > 1 and tag in CLOSED_BY.get(nodes[stack[-1]].tag, ()):
            close_from(len(stack) - 1)
        if tag in CLOSED_BY["p"] and (k := open_at("p", False)) is not None:  # even if inline elements are open in it
            close_from(k)
        if tag in BLOCK:
            block += 1
        if tag in VOID:
            if tag == "br":
                texts.append((stack[-1], block, " "))
            continue
        names, hidden = frozenset(), False
        if rest:
            found: dict[str, str] = {}
            for a in ATTRIBUTES.finditer(rest):
                if (name := a[1].lower()) in READ:
                    found.setdefault(name, a[2] or a[3] or a[4] or "")  # the first of a name counts
            words = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
            names = frozenset(WORD.findall(words))
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        up = nodes[stack[-1]]
        up.children += 1
        nodes.append(Node(tag, stack[-1], names, up.depth + 1, up.fixed or hidden or tag in FIXED))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            stop = end.start() if end else n
            if tag in ("textarea", "title"):
                texts.append((len(nodes) - 1, block, entities.unescape(page[at:stop])))
            at = end.end() if end else n
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in FENCE:
            fences.append(len(stack))
        stack.append(len(nodes) - 1)
    return nodes, texts


FEATURES = 15


def features(nodes: list[Node], texts: list[tuple[int, int, str]]) -> np.ndarray:
    linked = [False] * len(nodes)
    for k, x in enumerate(nodes):
        linked[k] = x.tag == "a" or (x.parent >= 0 and linked[x.parent])
    for k, _, t in texts:
        size = len(t.strip())
        nodes[k].chars += size
        nodes[k].stops += t.count(".") + t.count(",")
        if linked[k]:
            nodes[k].links += size
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[nodes[k].parent]
        up.chars += nodes[k].chars
        up.links += nodes[k].links
        up.stops += nodes[k].stops
    out = []
    for x in nodes:
        inline = x.tag in INLINE
        y = nodes[x.parent] if inline else x  # a link in running text is as dense as its paragraph
        size = max(1, y.chars)
        out.append((
            1, x.tag == "article", x.tag == "main", x.tag in ("p", "pre", "blockquote"), x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), x.tag in ("ul", "ol", "li", "dl"), x.tag == "header",
            bool(x.names & BOILERPLATE), bool(x.names & CONTENT), y.links / size, min(1.0, y.chars / 400), min(1.0, 20 * y.stops / size), min(1.0, x.depth / 10), inline, x.tag in ("div", "section"),
        ))
    return np.array(out, np.float64).reshape(-1, FEATURES)


class Forest:
    """The trees of many pages at once: each node's parent (-1 for a page), and the nodes of each depth."""

    def __init__(self, trees: list[list[Node]]):
        sizes = np.fromiter(map(len, trees), np.int64, len(trees))
        self.starts = np.cumsum(sizes) - sizes
        self.parent = np.array([x.parent + at if x.parent >= 0 else -1 for at, tree in zip(self.starts.tolist(), trees) for x in tree], np.int64)
        depth = np.array([x.depth for tree in trees for x in tree], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def marginals(forest: Forest, own: np.ndarray, pair: np.ndarray, clamp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-product: each node's content marginal, each child's joint with its parent (parent, child), and log Z of its
    page. Messages go up and down a level of all pages at a time.

    own: the log potential of content less that of boilerplate, a node; pair: log potentials (parent, child);
    clamp: 0 or 1 for known nodes, -1 for the others.
    """
    n, parent = len(forest.parent), forest.parent
    up = np.zeros((n, 2))  # a node's belief from below, by state
    up[:, 1] = own
    if clamp is not None:
        up[clamp == 0, 1] = -1e9
        up[clamp == 1, 0] = -1e9
    send, joint, full, z = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros(n)
    for level in forest.levels[:0:-1]:  # upward
        send[level] = np.logaddexp(pair[:, 0] + up[level, :1], pair[:, 1] + up[level, 1:])
        np.add.at(up, parent[level], send[level])
    for k, level in enumerate(forest.levels):  # downward
        if not k:
            full[level], z[level] = up[level], np.logaddexp(up[level, 0], up[level, 1])
            continue
        without = full[parent[level]] - send[level]  # the parent without this child
        z[level] = z[parent[level]]
        joint[level] = without[:, :, None] + pair[None] + up[level][:, None, :] - z[level][:, None, None]
        full[level] = up[level] + np.logaddexp(without[:, :1] + pair[0], without[:, 1:] + pair[1])
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), np.exp(np.clip(joint, -500, 0)), z


def labelled_pages(n: int = 160, seed: int = 7) -> list[tuple[str, set[str]]]:
    """Pages made by rule, with the texts that are content: articles among menus, headers, footers, sidebars, notices,
    adverts, forms, related links and reader comments, under the markup that publishers use for them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "ka lo mi ten sur pra del vo shi ran ge bu not far que il est und die".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(lo, hi))))

    def sentence(lo: int = 4, hi: int = 14) -> str:
        return words(lo, hi).capitalize() + pick([".", ".", ".", ",", "!"])

    out = []
    for number in range(n):
        content: set[str] = set()
        count = iter(range(10_000))

        def good(text: str) -> str:
            text = f"{text} g{next(count)}x"
            content.add(text)
            return text

        def bad(text: str) -> str:
            return f"{text} z{next(count)}x"

        def paragraph() -> str:
            return f"<p>{good(' '.join(sentence() for _ in range(int(rng.integers(1, 7)))))}</p>"

        def links(k: int) -> str:
            return "<ul>" + "".join(f'<li><a href="/{j}">{bad(words(1, 3))}</a></li>' for j in range(k)) + "</ul>"

        body = []
        for _ in range(int(rng.integers(1, 9))):
            kind = rng.random()
            if kind < 0.7:
                body.append(paragraph())
            elif kind < 0.78:
                body.append(f"<{(h := pick(['h2', 'h3']))}>{good(words(1, 6))}</{h}>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{good(sentence(2, 9))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                body.append(f"<blockquote>{good(sentence())}</blockquote>")
            elif kind < 0.96:
                body.append(f"<p>{good(sentence())} <a href='/x'>{good(words(1, 3))}</a> {good(sentence())}</p>")
            else:
                body.append(f'<div class="{pick(["ad", "advert", "promo", "share", "related", "newsletter"])}">{bad(sentence())}</div>')
        title = f"<h1>{good(words(2, 9))}</h1>"
        if rng.random() < 0.2:
            title = f"<header>{title}</header>"
        box = pick(["article", "article", "article", "main", 'div class="content"', 'div id="main-content"', 'section class="post"', 'div class="entry-content"'])
        article = f"<{box}>{title}{''.join(body)}</{box.split()[0]}>"
        parts = []
        if rng.random() < 0.5:
            parts.append(f'<{(h := pick(["header", "div class=" + chr(34) + "header" + chr(34), "div id=" + chr(34) + "masthead" + chr(34)]))}>{bad(words(1, 5))}</{h.split()[0]}>')
        if rng.random() < 0.8:
            parts.append(f'<{(h := pick(["nav", "div class=" + chr(34) + "menu" + chr(34), "div class=" + chr(34) + "navbar" + chr(34)]))}>{links(int(rng.integers(2, 8)))}</{h.split()[0]}>')
        for name in ("cookie-notice", "ad", "banner", "notice", "breadcrumb", "social-share"):
            if rng.random() < 0.35:
                parts.append(f'<div class="{name}">{bad(sentence())}</div>')
        parts.append(article)
        if rng.random() < 0.4:
            parts.append(f'<{(h := pick(["section", "div"]))} class="{pick(["comments", "comment-list", "replies"])}"><h3>{bad("Comments")}</h3>' + "".join(f'<div class="comment"><p>{bad(" ".join(sentence() for _ in range(2)))}</p></div>' for _ in range(int(rng.integers(1, 5)))) + f"</{h}>")
        if rng.random() < 0.5:
            parts.append(f'<{(h := pick(["aside", "div class=" + chr(34) + "sidebar" + chr(34), "div id=" + chr(34) + "sidebar" + chr(34)]))}><h3>{bad(words(1, 3))}</h3>{links(4)}<p>{bad(sentence())}</p></{h.split()[0]}>')
        if rng.random() < 0.3:
            parts.append(f'<form action="/s"><label>{bad(words(1, 3))}</label><input name="q"></form>')
        parts.append(f'<{(h := pick(["footer", "footer", "div class=" + chr(34) + "footer" + chr(34)]))}>{bad("&copy; " + sentence())}</{h.split()[0]}>')
        inner = "".join(parts)
        if rng.random() < 0.4:
            inner = f'<div id="{pick(["page", "wrapper", "container"])}">{inner}</div>'
        out.append((f"<html><head><title>{bad('t')}</title></head><body>{inner}</body></html>", content))
    return out


@lru_cache
def trained(rounds: int = 120, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and log potentials (parent, child), fitted on labelled_pages()."""
    trees, xs, labels = [], [], []
    for page, content in labelled_pages():
        nodes, texts = parse(page)
        label = np.zeros(len(nodes), np.int64)
        for k, _, t in texts:
            if t.strip() in content:
                label[k] = 1
        for k in range(len(nodes) - 1, 0, -1):  # an element is content if any element in it is, up to the page's body
            if label[k] and nodes[k].parent >= 0 and nodes[nodes[k].parent].tag not in ("#page", "html"):
                label[nodes[k].parent] = 1
        trees.append(nodes)
        xs.append(features(nodes, texts))
        labels.append(label)
    forest, x, label = Forest(trees), np.concatenate(xs), np.concatenate(labels)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[forest.parent[child]], label[child]), 1)
    w, pair = np.zeros(FEATURES), np.array([[0.5, -0.5], [-0.5, 0.5]])
    for _ in range(rounds):
        m, joint, _ = marginals(forest, x @ w, pair)
        w += rate * 20 * (x.T @ (label - m) / len(x) - 1e-4 * w)
        pair += rate * 4 * ((seen - joint[child].sum(axis=0)) / len(x) - 1e-4 * pair)
    return w, pair


def extract_all(pages: list[str | None], w: np.ndarray, pair: np.ndarray) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    if not parsed:
        return []
    forest = Forest([nodes for nodes, _ in parsed])
    x = np.concatenate([features(nodes, texts) for nodes, texts in parsed])
    clamp = np.array([0 if q.fixed else -1 for nodes, _ in parsed for q in nodes])
    keep = (marginals(forest, x @ w, pair, clamp)[0] >= 0.5).tolist()
    out = []
    for at, (_, texts) in zip(forest.starts.tolist(), parsed):
        blocks: dict[int, list[str]] = {}
        for k, block, t in texts:
            if keep[at + k]:
                blocks.setdefault(block, []).append(t)
        joined = (SPACE.sub(" ", "".join(b)).strip(" ") for b in blocks.values())
        out.append("\n\n".join(b for b in joined if b))
    return out


def extract(page: str | None, w: np.ndarray, pair: np.ndarray) -> str:
    return extract_all([page], w, pair)[0]


def main_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    ship(pages.sparkSession)
    w, pair = trained()
    rows = pages.select(*keep, F.col(column).alias("__html"))
    schema = pages.select(*keep).schema.add("text", "string")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__html"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(extract_all(part.column("__html").to_pylist(), w, pair), pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(f, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
