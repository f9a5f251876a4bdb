"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat row of text blocks.  Each block has its word count and
link density, those of the blocks before and after it, and marks of the
elements around it.  A decision tree, grown on a small labelled table (drawn
from the kinds of blocks below), says which blocks are main text.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import slices

FEATURES = ("words_before", "words", "words_after", "links_before", "links", "links_after", "content", "boiler", "heading")

#: Kinds of labelled blocks: ranges of words and of link density of the block before, the block and the one after, whether
#: inside an article element, inside boilerplate, a heading (2: either); then 1 for main text.
KINDS = """
0-150 0-1   1-150 0-1   0-150 0-1   2 1 2  0
0-0   0-0   1-8   .8-1  1-8   .8-1  0 0 0  0
1-8   .8-1  1-8   .8-1  1-8   .8-1  2 0 0  0
1-8   .8-1  1-8   .8-1  0-0   0-0   2 0 0  0
1-8   .8-1  1-8   .8-1  1-150 0-.3  2 0 2  0
5-150 0-.3  1-8   .8-1  1-8   .8-1  2 0 0  0
1-30  .6-1  9-30  .6-1  1-30  .6-1  0 0 0  0
0-150 0-.3  1-40  .7-1  0-150 0-.3  0 0 0  0
1-8   .8-1  1-6   0-.2  1-8   .8-1  0 0 0  0
1-8   .8-1  1-6   0-.2  0-0   0-0   0 0 0  0
1-8   .8-1  1-14  0-.3  5-150 0-.3  0 0 1  1
0-150 0-.3  1-14  0-.3  1-150 0-.3  2 0 1  1
0-150 0-.3  1-20  0-.5  0-150 0-.3  1 0 0  1
0-150 0-1   12-250 0-.5 0-150 0-1   1 0 0  1
1-8   .8-1  1-12  0-.3  1-8   .8-1  1 0 2  1
1-8   .8-1  1-12  0-.3  0-150 0-.3  1 0 2  1
0-150 0-.3  1-12  0-.3  1-8   .8-1  1 0 2  1
0-150 0-.3  1-40  .5-1  0-150 0-.3  1 0 2  1
0-150 0-1   12-250 0-.4 0-150 0-1   0 0 0  1
0-150 0-.2  1-12  0-.3  0-150 0-.2  0 0 0  1
0-0   0-0   1-12  0-.3  0-150 0-.3  0 0 2  1
0-150 0-1   1-150 0-1   0-0   0-0   2 1 2  0
0-0   0-0   1-150 0-1   0-0   0-0   2 1 2  0
0-150 0-.3  1-250 0-.5  0-0   0-0   1 0 2  1
0-0   0-0   1-250 0-.5  0-0   0-0   1 0 2  1
0-150 0-.3  1-40  .5-1  0-0   0-0   1 0 2  1
0-0   0-0   1-40  .5-1  0-0   0-0   1 0 2  1
1-8   .8-1  1-250 0-.4  0-0   0-0   1 0 2  1
0-150 0-.2  1-250 0-.3  0-0   0-0   0 0 2  1
0-0   0-0   1-250 0-.3  0-0   0-0   0 0 2  1
1-8   .8-1  12-250 0-.3 0-0   0-0   0 0 2  1
"""


def labelled(kinds: str = KINDS, each: int = 24, seed: int = 7) -> np.ndarray:
    """The labelled table: ``each`` blocks of every kind, numbers drawn within its ranges, by FEATURES and label."""
    rng, out = np.random.default_rng(seed), []
    for line in kinds.split("\n"):
        if cells := line.split():
            ranges = [tuple(map(float, x.split("-"))) for x in cells[:6]]
            drawn = np.array([rng.uniform(a, b, each) for a, b in ranges])
            drawn[::2] = np.rint(drawn[::2])
            drawn[1::2][drawn[::2] == 0] = 0  # no words, no links
            flags = [rng.integers(0, 2, each) if x == "2" else np.full(each, int(x)) for x in cells[6:]]
            out.append(np.array([*drawn[[0, 2, 4]], *drawn[[1, 3, 5]], *flags]).T)
    return np.concatenate(out)


#: Names that mark boilerplate in tags, classes, ids and roles, and tags that hold no text (fixed values).
BOILER_TAGS = frozenset("nav footer aside form dialog menu".split())
BOILER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead "
    "footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended comment comments disqus respond reply replies pagination pager toolbar copyright legal disclaimer contentinfo complementary search "
    "dialog skip".split()
)
#: Of these, those that may be what an article is about, and mark nothing on an article or main element itself.
TOPICS = frozenset("social legal copyright alert search notice".split())
#: Those that hold articles of their own, which stay boilerplate; and tags that stay so.
READERS = frozenset("comment comments disqus respond reply replies related recommended".split())
KEPT_OUT = frozenset("nav footer aside dialog menu".split())
#: Words that may stand beside those names in one class, as in site-footer; any other word (has-sidebar, no-ads) makes it another class.
NEUTRAL = frozenset("site page main top bottom left right list item items box bar area wrap wrapper inner container section block link links widget form text global".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video head title select option datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening tag closes an open one of these, up to the container named.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

_RAW = r"script|style|noscript|template|iframe|textarea|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<end>/?)(?P<odd>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")


class Marks(NamedTuple):
    """Inside an article or the like; inside boilerplate; inside boilerplate that no article lifts."""

    content: bool = False
    boiler: bool = False
    out: bool = False


class Block(NamedTuple):
    text: str
    words: int
    linked: int  # words inside links
    content: bool
    boiler: bool
    heading: bool


def grow(rows: np.ndarray, depth: int = 10, least: int = 4):
    """A binary tree by Gini impurity: (feature, threshold, left, right) or a leaf's share of main text."""
    x, y = rows[:, :-1], rows[:, -1]
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), left)
    if best is None:
        return share
    _, f, cut, left = best
    return (f, cut, grow(rows[left], depth - 1, least), grow(rows[~left], depth - 1, least))


def judge(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def is_hidden(name: str, value: str) -> bool:
    """Whether an attribute hides its element."""
    if name == "style":
        declared = {k.strip(): v.replace("!important", "").strip() for k, _, v in (x.partition(":") for x in value.split(";"))}
        return declared.get("display") == "none" or declared.get("visibility") == "hidden"
    return name == "hidden" and not value.startswith("until") or name == "aria-hidden" and value == "true"


def is_boiler(token: str, in_content: bool, article: bool = False) -> bool:
    """Whether a whole class, id or role says boilerplate: all its words do, or stand beside one that does."""
    names = set(NAME.findall(token))
    marks = BOILER_NAMES if in_content else BOILER_NAMES | {"header"}
    marks = marks - TOPICS if article else marks
    return token == "hidden" or bool(names & marks) and names <= marks | NEUTRAL


def element_marks(tag: str, attributes: str, around: Marks) -> Marks:
    """What holds inside an element, by its tag and attributes and what holds around it.

    An article inside a wrapper with a boilerplate name is an article still,
    unless it, or the comments or asides that it stands in, are boilerplate.
    """
    if tag in ("html", "body"):
        return Marks()
    article = tag in ("article", "main")
    named, boiler, out = article, tag in BOILER_TAGS or (tag == "header" and not around.content), tag in KEPT_OUT
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), htmllib.unescape(m[2] or m[3] or m[4] or "").strip().lower()
        if name in ("class", "id", "role"):
            named |= bool(set(NAME.findall(value)) & CONTENT_NAMES)
            for token in value.split():
                if is_boiler(token, around.content or named, article):
                    boiler, out = True, out or bool(set(NAME.findall(token)) & READERS)
        elif is_hidden(name, value):
            boiler = out = True
    lifted = article and not boiler and not around.out
    return Marks(around.content or named and not boiler, not lifted and (around.boiler or boiler), around.out or out)


class Page:
    """Open elements of a page and its flat text blocks so far; each step takes the same time however deep they nest."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Marks]] = []
        self.open: Counter[str] = Counter()
        self.silent = 0  # open elements without text
        self.text: list[str] = []
        self.linked = 0  # words inside links

    def add(self, text: str) -> None:
        if text and not self.silent:
            self.text.append(text)
            if self.open["a"]:
                self.linked += len(text.split())

    def end_block(self) -> None:
        joined = " ".join(htmllib.unescape("".join(self.text)).split())
        if joined:
            n = joined.count(" ") + 1
            heading = any(tag in HEADINGS for tag, _ in self.stack[-3:])
            inside = self.stack[-1][1] if self.stack else Marks()
            self.blocks.append(Block(joined, n, min(n, self.linked), inside.content, inside.boiler, heading))
        self.text, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        for tag, _ in self.stack[depth:]:
            self.open[tag] -= 1
            self.silent -= tag in SILENT
        del self.stack[depth:]

    def close_one(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Ends the innermost open one of ``tags``, but none outside an element of ``within``."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.close_to(i)
                return
            if self.stack[i][0] in within:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end_block()
            if tag not in VOID:
                self.close_one({"p"}, BLOCK - {"p"})  # an open paragraph ends before a block
        if tag in VOID:
            return
        if tag in CLOSES:
            self.close_one(*CLOSES[tag])
        if tag == "a":
            self.close_one({"a"}, BLOCK)  # links don't nest
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            self.stack.append((tag, element_marks(tag, attributes, self.stack[-1][1] if self.stack else Marks())))
            self.open[tag] += 1
            self.silent += tag in SILENT

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        self.close_one({tag}, frozenset())


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    p, at = Page(), 0
    for m in TOKEN.finditer(page):
        p.add(page[at : m.start()])
        at = m.end()
        if m["odd"]:  # a quote that never ends: the tag ends at its first bracket
            (p.end if m["end"] else lambda t: p.start(t, ""))(m["odd"].lower())
        elif m[3]:
            p.end(m[3].lower()) if m[2] else p.start(m[3].lower(), m[4])
        elif m[1] and m[1].lower() == "title":
            p.end_block()
    p.add(page[at:])
    p.end_block()
    return p.blocks


def features(found: list[Block]) -> Iterator[tuple]:
    """FEATURES of each block, with those of its neighbours."""
    none = Block("", 0, 0, False, False, False)
    density = lambda b: b.linked / max(1, b.words)
    for p, b, n in zip([none, *found], found, [*found[1:], none], strict=False):
        yield p.words, b.words, n.words, density(p), density(b), density(n), b.content, b.boiler, b.heading


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, x in zip(found, features(found), strict=True) if judge(tree, x) >= 0.5)


def extract_main_text(pages: DataFrame, rows: np.ndarray | None = None, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; other columns are ignored.

    ``rows`` are labelled blocks (FEATURES, then 1 for main text) to grow the tree on.

    A null or empty page, or one with no main text, has an empty text; a page cut
    off in a tag or comment ends there.  Very long pages are read whole, in time in
    proportion to their length.  Repeated rows stay repeated, null ids
    and urls stay null, and an empty table gives no rows.  No shuffle.
    """
    tree = grow(labelled() if rows is None else rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html_"):
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.selectExpr("page_id", "url", f"`{html_col}` as html_").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_block_tree_text(spark, sf_dir):
    from .common import table

    return extract_main_text(table(spark, sf_dir, "pages"))
