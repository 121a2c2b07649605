"""Main text of web pages: gradient-boosted trees over the nodes of the document tree, decoded as a tree.

A page becomes a tree of block elements (inline markup belongs to the block around it). Every block is described by
what its subtree holds (text, links, sentences, tags per text), its name tokens, its place among its siblings and in
the page, and what encloses it; boosted trees give the odds that it holds part of the article. Decoding picks the best
set of blocks in which everything inside a dropped block is dropped, so no text is kept against its ancestors: the
value of a block is its own log odds plus the values of its children, and a block of negative value goes with all it
holds.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_layouts
from .common import prepare

TREES, DEPTH, RATE, BINS, SMOOTHING, LEAST = 60, 4, 0.25, 32, 1.0, 8

# The elements of HTML by how they lay out.
_RAW = frozenset("script style template textarea title iframe svg select canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = (
    "html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
    "thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog center menu object noscript"
).split()
_BLOCK = frozenset(_BLOCKS)
_IN_P = _BLOCK - frozenset(("html", "body", "td", "th", "tr", "caption", "object", "noscript"))  # what a paragraph cannot hold
_IN_HEAD = frozenset(("base", "basefont", "bgsound", "link", "meta", "noscript"))  # besides those of _RAW; all others end it
_LIST_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"""((?:"[^"]*+"|'[^']*+'|[^>"']++)*+)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAMED, _MARKED = (re.compile(rf"""(?:^|\s)({names})\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I) for names in (
    "class|id|role", f"class|id|role|{html_layouts.MARK}"))
_WORDS = re.compile("[a-z]+")

_KINDS = list(html_layouts.NAMES)
_STEMS = {name: kind for kind, names in enumerate(html_layouts.NAMES.values()) for name in names.split()}
_TAG_GROUPS = ("article main", "section", "div", "nav menu", "header", "footer", "aside dialog", "form fieldset", "p", "h1",
               "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tr td th", "blockquote pre", "html body")
_GROUP = {tag: i for i, tags in enumerate(_TAG_GROUPS) for tag in tags.split()}


def _tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, element, whether it is an end tag, and attributes of every tag; other markup has no element.

    Reads on from every character at most a few times: a tag that has no end takes the rest of the page with it, and
    once a quote is not closed again, quotes no longer hide the end of a tag.
    """
    at, size, last, quoted = 0, len(source), source.rfind(">"), True
    while (at := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), at):
            comment = source.startswith("<!--", at)
            end = source.find("-->", at + 4) + 3 if comment else source.find(">", at) + 1
            end = end if end > at else size
            yield at, end, None, False, ""
            at = end
            continue
        start = _START.match(source, at)
        if not start:
            at += 1
            continue
        if at > last:
            yield at, size, None, False, ""
            return
        name, closing, end = start.group(2).lower(), bool(start.group(1)), start.end()
        rest = _REST.match(source, end) if quoted else None
        if rest:
            attributes, end = rest.group(1), rest.end()
        else:
            quoted = False
            close = source.find(">", end)
            attributes, end = source[end:close], close + 1
        if name in _RAW and not closing and not attributes.endswith("/"):
            stop = _RAW_END[name].search(source, end)
            end = (source.find(">", stop.end()) + 1 if stop else 0) or size
            yield at, end, None, False, ""
        else:
            yield at, end, name, closing, attributes
        at = end


class _Open:
    """Open elements and the block each belongs to; the nearest of a name is known without a search."""

    def __init__(self):
        self.elements: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.links = 0

    def push(self, name: str, block: int) -> None:
        self.places[name].append(len(self.elements))
        if name in _BLOCK:
            self.blocks.append(len(self.elements))
        self.elements.append((name, block))
        self.links += name == "a"

    def nearest(self, *names: str) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> bool:
        """Close the element at ``place`` and all inside it; whether a block was among them."""
        block = False
        for name, _ in self.elements[place:]:
            self.places[name].pop()
            self.links -= name == "a"
            if name in _BLOCK:
                self.blocks.pop()
                block = True
        del self.elements[place:]
        return block


class Page:
    """Blocks of one page in document order, the text of each, and what its start tag says.

    ``marked`` pages are annotated ones: only there the marker attribute is read.
    """

    def __init__(self, source: str, marked: bool = False):
        self.tags, self.parents, self.kinds, self.marks = ["html"], [-1], [0], [None]
        self.inputs = [0]
        self.texts: list[tuple[int, str, bool, int]] = []  # block, text, inside a link, number of the run
        self._run, self._named = 0, _MARKED if marked else _NAMED
        self._read(source)

    def _read(self, source: str) -> None:
        stack = _Open()
        head = False
        at = 0
        for start, end, name, closing, attributes in _tokens(source):
            if start > at:
                between = source[at:start]
                head = head and between.isspace()
                if not head:
                    self._text(between, stack)
            at = end
            if name is None:
                continue
            if name == "head":
                head = not closing and len(self.tags) == 1
                continue
            head = head and (closing or name in _IN_HEAD)
            block = stack.elements[-1][1]
            if closing:
                closed = self._close(stack, name)
                self._run += name == "p" and not closed  # stands for an empty paragraph
            elif name in _VOID:
                if name == "br":
                    self.texts.append((block, " ", False, self._run))
                self.inputs[block] += name == "input"
            elif name == "html" or (name == "body" and len(stack.elements) > 1):
                continue
            else:
                if name in _IN_P and stack.blocks and stack.elements[stack.blocks[-1]][0] == "p":
                    self._close(stack, "p")
                if name in _LIST_ITEMS:
                    self._end_item(stack, name)
                block = stack.elements[-1][1]
                if name in _BLOCK:
                    block = self._open(name, block, attributes)
                else:
                    self.inputs[block] += name == "button"
                stack.push(name, block)
        if at < len(source) and not (head and source[at:].isspace()):
            self._text(source[at:], stack)

    def _text(self, text: str, stack: _Open) -> None:
        self.texts.append((stack.elements[-1][1], html.unescape(text) if "&" in text else text, stack.links > 0, self._run))

    def _open(self, name: str, parent: int, attributes: str) -> int:
        self.tags.append(name)
        self.parents.append(parent)
        self.inputs.append(0)
        kinds, mark = 0, None
        for key, value in self._named.findall(attributes) if attributes else ():
            value = value.strip("\"'").lower()
            if key == html_layouts.MARK:
                mark = int(value)
                continue
            for token in value.split():
                for part in {token, *_WORDS.findall(token)}:
                    kind = _STEMS.get(part, _STEMS.get(part.rstrip("s")))
                    if kind is not None:
                        kinds |= 1 << kind
        self.kinds.append(kinds)
        self.marks.append(mark)
        self._run += 1
        return len(self.tags) - 1

    def _close(self, stack: _Open, name: str) -> bool:
        place = stack.nearest(name)
        # an inline end tag does not close the block around it
        if not place or (name not in _BLOCK and stack.blocks and stack.blocks[-1] > place):
            return False
        self._run += stack.cut(place)
        return True

    def _end_item(self, stack: _Open, name: str) -> None:
        alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
        place = stack.nearest(*alike)
        if place > stack.nearest(*_LIST_ITEMS[name]):
            self._run += stack.cut(place)

    def features(self) -> np.ndarray:
        """One row per block."""
        n = len(self.tags)
        parents = np.array(self.parents)
        own = np.zeros((n, 4))  # characters, linked characters, words, sentence ends
        for block, text, linked, _ in self.texts:
            size = len(text)
            if size > 1 or not text.isspace():
                row = own[block]
                row[0] += size
                row[1] += size * linked
                row[2] += text.count(" ") + 1
                row[3] += text.count(". ") + text.count(".\n") + (text.rstrip()[-1:] in ".!?…" and text.strip() != "")
        group = np.array([_GROUP.get(t, len(_TAG_GROUPS)) for t in self.tags])
        counts = np.zeros((n, 5))  # blocks, paragraphs, items, headings, inputs
        counts[:, 0], counts[:, 1], counts[:, 2] = 1, group == 8, group == 12
        counts[:, 3], counts[:, 4] = (group == 9) | (group == 10), self.inputs
        whole = np.concatenate([own, counts], axis=1)
        depth, place, children = np.zeros(n), np.zeros(n), np.zeros(n)
        before = np.concatenate([[0], np.cumsum(own[:, 0])])[:-1]
        above = np.zeros(n, np.int64)
        above_group = np.zeros(n, np.int64)
        kinds = np.array(self.kinds, np.int64)
        for i in range(1, n):
            p = self.parents[i]
            depth[i], place[i] = depth[p] + 1, children[p]
            children[p] += 1
            above[i] = above[p] | kinds[p]
            above_group[i] = above_group[p] | (1 << int(group[p]))
        for i in range(n - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
        total = max(whole[0, 0], 1)
        chars = np.maximum(whole[:, 0], 1)
        up = np.maximum(parents, 0)
        columns = [
            np.log1p(whole[:, 0]), whole[:, 0] / total, whole[:, 1] / chars, whole[:, 2] / whole[:, 4],
            whole[:, 3] / np.maximum(whole[:, 2], 1), whole[:, 4] / chars, whole[:, 5], whole[:, 6], whole[:, 7], whole[:, 8],
            np.log1p(own[:, 0]), depth, children, place, place / np.maximum(children[up], 1), children[up],
            before / total, (before + whole[:, 0]) / total, whole[up, 1] / chars[up], whole[:, 0] / chars[up],
            whole[up, 3] / np.maximum(whole[up, 2], 1), group, group[up], kinds > 0,
        ]
        columns += [(kinds >> k) & 1 for k in range(len(_KINDS))] + [(above >> k) & 1 for k in range(len(_KINDS))]
        columns += [group == g for g in range(len(_TAG_GROUPS))] + [(above_group >> g) & 1 for g in (0, 3, 4, 5, 6, 7)]
        return np.stack([np.asarray(c, float) for c in columns], axis=1)

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Which blocks are kept: those of positive value whose ancestors are all kept."""
        value = odds.tolist()
        for i in range(len(value) - 1, 0, -1):
            if value[i] > 0:
                value[self.parents[i]] += value[i]
        kept = [value[0] > 0]
        for i in range(1, len(value)):
            kept.append(kept[self.parents[i]] and value[i] > 0)
        return kept

    def text(self, kept: list[bool]) -> str:
        """Blocks in page order, one per line, white space inside a block as one blank."""
        lines: list[list[str]] = []
        last = None
        for block, text, _, run in self.texts:
            if kept[block]:
                if last != (block, run):
                    lines.append([])
                    last = (block, run)
                lines[-1].append(text)
        return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in lines)))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="right") for c, column in zip(cuts, x.T)])


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Gradient-boosted trees of ``DEPTH`` levels on binned features; each tree is complete, unused splits send all left."""
    cuts = _cuts(x)
    bins = _binned(x, cuts)
    margin, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        place = np.zeros(len(y), np.int64)
        features, levels = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, BINS + 1)
        for depth in range(DEPTH):
            width = 2 ** depth
            best = np.zeros(width)
            for f in range(len(bins)):
                cell = place * BINS + bins[f]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(1)
                w = np.bincount(cell, weight, width * BINS).reshape(width, BINS).cumsum(1)
                k = np.bincount(cell, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                gain = (g ** 2 / (w + SMOOTHING) + (g[:, -1:] - g) ** 2 / (w[:, -1:] - w + SMOOTHING)
                        - g[:, -1:] ** 2 / (w[:, -1:] + SMOOTHING))
                gain[(k < LEAST) | (k[:, -1:] - k < LEAST)] = 0
                top = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[node] = gain[node, top[node]]
                    features[width - 1 + node], levels[width - 1 + node] = f, top[node]
            node = width - 1 + place
            place = 2 * place + (bins[features[node], np.arange(len(y))] > levels[node])
        leaves = RATE * np.bincount(place, gradient, 2 ** DEPTH) / (np.bincount(place, weight, 2 ** DEPTH) + SMOOTHING)
        margin += leaves[place]
        trees.append((features, levels, leaves))
    return {"cuts": cuts, "trees": trees}


def odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of every row."""
    bins, rows = _binned(x, model["cuts"]), np.arange(len(x))
    out = np.zeros(len(x))
    for features, levels, leaves in model["trees"]:
        place = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            node = 2 ** depth - 1 + place
            place = 2 * place + (bins[features[node], rows] > levels[node])
        out += leaves[place]
    return out


def train(spark: SparkSession, layouts: int = html_layouts.LAYOUTS) -> Broadcast:
    """Fit on ``layouts`` annotated pages; the outermost block counts as kept."""
    pages = [Page(p, marked=True) for p in html_layouts.pages(layouts)]
    marks = np.array([m if m is not None else 1 for p in pages for m in p.marks], float)
    return spark.sparkContext.broadcast(boost(np.concatenate([p.features() for p in pages]), marks))


def extract_pages(sources: list[str | None], model: dict) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    real = [p for p in pages if p]
    if not real:
        return [""] * len(pages)
    rows = [p.features() for p in real]
    scores = np.split(odds(model, np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
    texts = iter([p.text(p.decode(s)) for p, s in zip(real, scores)])
    return [next(texts) if p else "" for p in pages]


def extract(df: DataFrame, model: Broadcast, source: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of the page in ``source``.

    Null and empty pages, and pages without an article, give empty texts. Markup that is not closed or nested as it
    should be is read as browsers do; a tag, comment or raw element that has no end takes the rest of the page. The time
    a page takes grows with its length, whatever it holds. A column named ``out`` is replaced; the other columns and repeated rows stay; an
    empty table gives an empty table.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("string")
    def extracted(sources: pa.Array) -> pa.Array:
        return pa.array(extract_pages(sources.to_pylist(), model.value), pa.string())

    return df.withColumn(out, extracted(F.col(source)))
