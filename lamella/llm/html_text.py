"""HTML extraction: flat text blocks with the word count and link density of their neighbours, classified by a
decision tree that is trained on a small labelled table.

A page is read tag by tag. Text between the borders of block-level elements is one block; other tags leave no trace;
comments, scripts, styles, templates, titles and form fields are no text; character references are decoded, and white
space becomes single blanks. Every block has numbers only (``FEATURES``): its own word count and link density, those
of the blocks before and after it, and those of its container, the element in which its paragraph stands among
others. Names of articles, classes and roles are no features: a page whose ``article`` is a ``div`` reads the same.
The labelled table is ``labelled_pages``: small invented pages whose main blocks are marked.

A check follows the tree. Parts that the page itself marks as menu, header, footer, sidebar, notice, advert, form or
reader comment go, whatever the tree says; the check adds nothing.

Defined cases: null or empty html gives an empty text; markup may be unclosed or cut off at any place (an unclosed
script or style ends at the next element's border); blocks without words vanish; repeated rows are extracted alike;
further columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
#: Elements whose content is read up to their closing tag and is no text of the page.
RAW = frozenset("script style template title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a new line or box when shown; all others run on in the line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph, and items that end an open item of their kind.
ENDS_PARAGRAPH = BLOCK - frozenset("button optgroup option select caption tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())
#: The check: elements that are never the article, and words of class and id that say so.
FRAME = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "dialog": "notice"}
NAMED = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager".split(),
    "header": "header masthead topbar site-header banner".split(),
    "footer": "footer site-footer colophon copyright legal".split(),
    "aside": "aside sidebar widget related recommended promo promos teaser teasers share sharing social".split(),
    "notice": "notice notices cookie cookies consent gdpr popup modal alert newsletter subscribe signup paywall disclaimer".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors".split(),
    "form": "form search searchbox login".split(),
    "comment": "comment comments reply replies discussion disqus respond".split(),
}
WORDS_OF = {w: kind for kind, words in NAMED.items() for w in words}
#: Class names that begin so say what a box has or shows, not what it is.
ABOUT = frozenset("has with without no is show hide had".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACES = re.compile(r"\s+")
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "alert": "notice", "dialog": "notice"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    own: int  # number of the block-level element that holds the text
    parent: int  # the one around that
    grand: int  # and the one around both
    paragraph: bool
    heading: bool
    item: bool
    marked: bool  # inside what the page marks as no article


def kind_of(tag: str, attributes: str, in_article: bool) -> str | None:
    """What an element's name, class, id or role says it is; a header of the article itself says nothing."""
    found = FRAME.get(tag)
    if not found and attributes and tag not in ("html", "body"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            if name.lower() == "role":
                found = found or ROLES.get(value)
                continue
            for word in value.split():
                parts = re.split(r"[-_]", word)
                if parts[0] not in ABOUT:
                    found = found or next((WORDS_OF[x] for x in (word, *parts) if x in WORDS_OF), None)
    if found == "header" and in_article:
        return None
    return found


class Reader:
    """One pass over a page's tags, with the elements that are open."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, str | None, bool]] = []  # name, number, kind, in an article
        self.boxes: list[int] = [0]  # numbers of the open block-level elements
        self.open: Counter = Counter()
        self.kinds = 0
        self.number = 0
        self.parts: list[tuple[str, bool]] = []

    def flush(self) -> None:
        text = SPACES.sub(" ", entities.unescape("".join(p for p, _ in self.parts))).strip()
        if text:
            linked = sum(len(entities.unescape(p).split()) for p, a in self.parts if a)
            words = len(text.split())
            o = self.open
            grand, parent, own = [0, 0, *self.boxes][-3:]
            self.blocks.append(Block(text, words, min(linked, words), own, parent, grand, o["p"] > 0, any(o[h] for h in HEADINGS), o["li"] > 0, self.kinds > 0))
        self.parts.clear()

    def pop(self) -> str:
        name, _, kind, _ = self.stack[-1]
        if name in BLOCK or kind:
            self.flush()
        self.stack.pop()
        self.open[name] -= 1
        self.kinds -= kind is not None
        if name in BLOCK:
            self.boxes.pop()
        return name

    def close(self, names: tuple[str, ...], border: frozenset[str] = frozenset()) -> None:
        """Ends the last open element of these names and all inside it, if none of the border stands between."""
        if any(self.open[n] for n in names):
            for name, *_ in reversed(self.stack):
                if name in names:
                    break
                if name in border:
                    return
            while self.pop() not in names:
                pass

    def start(self, tag: str, attributes: str) -> None:
        within = bool(self.stack) and self.stack[-1][3]
        if tag in ENDS_PARAGRAPH:
            self.close(("p",), LISTS | {"td", "th", "button"})
        if tag in SIBLINGS:
            self.close(SIBLINGS[tag], LISTS)
        if tag == "a":
            self.close(("a",), BLOCK)
        if tag in ("article", "main") and not within and self.kinds:
            # what was left open before the article doesn't mark it
            self.flush()
            self.stack = [(name, number, None, inside) for name, number, _, inside in self.stack]
            self.kinds = 0
        kind = kind_of(tag, attributes, within)
        if tag in BLOCK or kind:
            self.flush()
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            return
        self.open[tag] += 1
        self.kinds += kind is not None
        self.number += 1
        if tag in BLOCK:
            self.boxes.append(self.number)
        self.stack.append((tag, self.number, kind, within or tag in ("article", "main")))

    def text(self, part: str) -> None:
        if part:
            self.parts.append((part, self.open["a"] > 0))


BORDER = re.compile(rf"<(?:/|(?:{'|'.join(sorted(BLOCK))})\b)[^>]*>", re.I)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    reader = Reader()
    unclosed: set[str] = set()  # raw elements that don't end any more
    at = 0
    while m := TAG.search(page, at):
        reader.text(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
                    border = BORDER.search(page, at)
                    at = border.start() if border else len(page)
        elif tag in ("br", "hr"):
            reader.text(" ")
        elif tag in VOID:
            continue
        elif closing:
            reader.close((tag,), frozenset() if tag in BLOCK else BLOCK)
        else:
            reader.start(tag, attributes)
    reader.text(page[at:])
    reader.flush()
    return reader.blocks


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "paragraph", "heading", "item",
    "container_words", "container_share", "container_density", "container_paragraphs", "container_headings", "around_share", "around_headings",
)


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row for each block.

    Its container is the element around its own one, or its own one where that holds other blocks as well. Words,
    share (of the page's words outside links), density, paragraphs (their share) and headings are of the blocks
    that stand directly in the container, or in the element around it.
    """
    n = len(blocks)
    if not n:
        return np.zeros((0, len(FEATURES)))
    words, linked = (np.array([getattr(b, x) for b in blocks], float) for x in ("words", "linked"))
    flags = [np.array([getattr(b, x) for b in blocks], float) for x in ("paragraph", "heading", "item")]
    holders = {b.parent for b in blocks}
    container = [b.own if b.own in holders else b.parent for b in blocks]
    around = [b.parent if c == b.own else b.grand for b, c in zip(blocks, container, strict=True)]
    place = {c: i for i, c in enumerate(dict.fromkeys([*container, *around]))}
    inner, outer = (np.array([place[c] for c in x]) for x in (container, around))
    total = lambda x: np.bincount(inner, x, len(place))
    free = words - linked
    share, size, count = total(free) / max(1.0, free.sum()), total(words), np.maximum(1, total(np.ones(n)))
    paragraphs, headings = total(flags[0]) / count, total(flags[1]) > 0
    density = linked / words
    near = lambda x, k: np.concatenate([[0.0], x[:-1]] if k else [x[1:], [0.0]])
    held = (total(linked) / np.maximum(1.0, size))[inner]
    return np.stack([words, density, near(words, 1), near(density, 1), near(words, 0), near(density, 0), *flags, size[inner], share[inner], held, paragraphs[inner], headings[inner], share[outer], headings[outer]], axis=1)


#: The labelled table's main blocks begin with this character, which is taken off before a page is used.
MAIN = "\x01"
LABELLED_PAGES = 900


def labelled_pages(n: int = LABELLED_PAGES, seed: int = 5) -> list[tuple[str, list[bool]]]:
    """(html, whether each block is main text): invented pages of many makes, the same ones at every call."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))) + r.choice([".", ".", "", "?"])
    link = lambda a=1, b=3: f"<a href='/{word()}'>{words(a, b)}</a>"
    some = lambda a, b, make: "".join(make() for _ in range(r.randint(a, b)))

    def length() -> tuple[int, int]:
        return r.choice([(1, 2), (1, 6), (3, 15), (10, 40), (20, 90), (60, 250)]) if r.random() < 0.97 else (300, 3000)

    def paragraph(longest: bool = False) -> str:
        body = MAIN + words(*((30, 120) if longest else length()))
        if r.random() < 0.2:
            body += f" {link()} {words(1, 12)}"
        return r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p><i>{body}</i></p>"])

    def article() -> str:
        title = f"<h1>{MAIN}{words(1, 12)}</h1>"
        kind = r.random()
        if kind < 0.3:  # few words
            inner = title + some(1, 2, lambda: r.choice([f"<p>{MAIN}{words(1, 8)}</p>", f"<p><b>{MAIN}{words(1, 8)}<br>", f"<p>{MAIN}{words(2, 30)} {link()} {words(1, 9)}</p>"]))
        elif kind < 0.7:
            inner = (title if r.random() < 0.9 else paragraph(True)) + some(2, 14, paragraph)
        else:
            parts = [title, paragraph(True), *(paragraph() for _ in range(r.randint(2, 8)))]
            extra = [
                lambda: "<ul>" + some(2, 6, lambda: f"<li>{MAIN}{words(*length())}</li>") + "</ul>",
                lambda: f"<h2>{MAIN}{words(1, 6)}</h2>",
                lambda: f"<blockquote><p>{MAIN}{words(4, 30)}</p></blockquote>",
                lambda: f"<section><h3>{MAIN}{words(1, 4)}</h3>{paragraph()}{paragraph(True)}</section>",
                lambda: "<table>" + some(1, 3, lambda: f"<tr><td>{MAIN}{words(1, 3)}</td><td>{MAIN}{words(1, 20)}</td></tr>") + "</table>",
                lambda: f"<pre>{MAIN}{words(2, 12)}</pre>",
                lambda: f"<figure><figcaption>{MAIN}{words(2, 12)}</figcaption></figure>",
                lambda: f"<p>{MAIN}{link(2, 6)}</p>",
            ]
            for _ in range(r.randint(1, 4)):
                parts.insert(r.randint(2, len(parts)), r.choice(extra)())
            inner = "".join(parts)
        return r.choice([f"<article>{inner}</article>", f"<div>{inner}</div>", f"<div><div>{inner}</div></div>", f"<main>{inner}</main>", f"<table><tr><td>{inner}</td></tr></table>"])

    def menu() -> str:
        items = some(2, 8, lambda: f"<li>{link()}</li>")
        return r.choice([f"<nav><ul>{items}</ul></nav>", f"<div><ul>{items}</ul></div>", f"<ul>{items}</ul>", f"<div>{some(2, 8, link)}</div>", f"<p>{some(2, 6, link)}</p>", f"<div>{words(1, 2)} {link()} | {link()} | {link()}</div>"])

    def advert() -> str:
        return r.choice([f"<div>{words(1, 30)}</div>", f"<div>{words(1, 30)}</div>", f"<div>{link(3, 10)}</div>", f"<div><div>{words(2, 12)}</div>{link()}</div>"])

    def teasers() -> str:
        return r.choice(["<div>" + some(2, 6, lambda: f"<p>{link(3, 12)}</p>") + "</div>", "<div><ul>" + some(2, 6, lambda: f"<li>{link(3, 12)}</li>") + "</ul></div>", "<div>" + some(2, 4, lambda: f"<div><h3>{link(2, 8)}</h3></div>") + "</div>"])

    def footer() -> str:
        return r.choice([f"<footer>&copy; {words(2, 25)}</footer>", f"<div>&copy; {words(2, 25)}</div>", f"<footer>{words(1, 4)} {link()} {link()}</footer>", f"<footer><div>{some(2, 5, link)}</div><div>{words(2, 12)}</div></footer>"])

    def site() -> str:
        return r.choice([f"<header>{words(1, 5)}</header>", f"<div>{words(1, 4)}</div>", f"<div>{link()}</div>"])

    out = []
    for _ in range(n):
        before = [site() if r.random() < 0.3 else "", menu() if r.random() < 0.85 else "", advert() if r.random() < 0.7 else ""]
        after = [advert() if r.random() < 0.4 else "", teasers() if r.random() < 0.3 else "", menu() if r.random() < 0.2 else "", footer() if r.random() < 0.9 else ""]
        page = "".join([*before, article(), *after])
        page = r.choice([f"<html><body>{page}</body></html>", f"<body>{page}", f"<body><div>{page}</div></body>"])
        labels = [MAIN in b.text for b in blocks_of(page)]
        out.append((page.replace(MAIN, ""), labels))
    return out


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: bool = False


DEPTH, LEAST = 14, 2


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """A tree of cuts that lower the Gini impurity most; ties go to the first feature and the lowest cut."""
    n = len(y)
    node = Node(label=bool(2 * y.sum() >= n))
    if depth == 0 or n < 2 * LEAST or y.min() == y.max():
        return node
    best = y.sum() * (1 - y.mean()) - 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        size = np.arange(1, n)
        low, rest = ones[:-1], ones[-1] - ones[:-1]
        impurity = low * (1 - low / size) + rest * (1 - rest / (n - size))
        impurity[(v[1:] <= v[:-1]) | (size < LEAST) | (n - size < LEAST)] = np.inf
        at = int(np.argmin(impurity))
        if impurity[at] < best - 1e-12:
            best, node.feature, node.cut = float(impurity[at]), f, float((v[at] + v[at + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@cache
def train(n: int = LABELLED_PAGES) -> Node:
    pages = labelled_pages(n)
    return grow(np.concatenate([features_of(blocks_of(page)) for page, _ in pages]), np.array([m for _, labels in pages for m in labels], float))


def is_main(node: Node, rows: np.ndarray) -> np.ndarray:
    """The tree's decision for each row of features."""
    out = np.zeros(len(rows), bool)
    todo = [(node, np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if node.feature < 0:
            out[own] = node.label
        elif len(own):
            low = rows[own, node.feature] <= node.cut
            todo += [(node.low, own[low]), (node.high, own[~low])]
    return out


def main_text(page: str | None, tree: Node, check: bool = True) -> str:
    """The blocks that the tree takes, without those that the page marks as no article (unless check is off)."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, main in zip(blocks, is_main(tree, features_of(blocks)).tolist(), strict=True) if main and not (check and b.marked))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The input's other columns by their place (c0, c1, ...), then text."""
    tree = train()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    others = [c for c in pages.columns if c != html_col]
    rows = pages.select(*(pages[c].alias(f"c{i}") for i, c in enumerate(others)), pages[html_col].cast("string").alias("html"))
    schema = ", ".join([*(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(others)), "text string"])
    return rows.mapInArrow(read, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(F.col("c0").alias("page_id"), F.col("c1").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_html_extraction": op10}
SQL: dict[str, str] = {}
