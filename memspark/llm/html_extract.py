"""Main text of web pages by a tree-structured graphical model.

Every block element of the page is a variable: content or not. Its own look (tag, names, length and link
share of its text) gives a potential on it, its label and its parent's one on each edge. Sum-product messages go up
from the leaves and down from the root; two passes give the exact marginal of every node. A
block of text is kept when the marginal of its element is above one half.

The potentials are counted on labelled pages: layouts of ``html_pages`` and a bounded sample of the table's own
pages whose markup names the article (an ``article`` element; parts such as ``nav`` or ``footer`` inside it, and those
named as comments, adverts or notices, do not belong to it). Extraction then reads every page whole and alone, in one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.html_pages import ADVERT, COMMENTS, NOTICE, labelled_pages

SAMPLE = 200  # pages of the table used for the fit, at most
SMOOTH = 2
# What the features of an element and those of its neighbours say is partly the same; this share of it is counted. Chosen on held-out layouts.
TEMPER = 0.4

# Fixed values of HTML: elements by the way they break lines and nest.
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption colgroup "
    "thead tbody tfoot tr td th ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript iframe object svg canvas audio video map datalist select button textarea title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES_ITSELF = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SAME_LEVEL = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS_P = BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption colgroup legend".split())

# Space or a slash, or a name with or without a value; a quote opens a value only right after "=", elsewhere it is an ordinary character.
_ATTRIBUTE = (
    r"[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
    r"(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+"
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    rf"|<([a-zA-Z][^\s/>]*)((?:{_ATTRIBUTE})*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Page:
    """Block elements in page order (a parent stands before its children) and the blocks of text."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    mark: list[str] = field(default_factory=list)
    letters: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str) -> int:
        names, mark = [], ""
        if attributes:
            for key, a, b, c in _NAMES.findall(attributes):
                if key.lower() == "data-content":
                    mark = a or b or c
                else:
                    names += [p.lower() for p in _PART.findall(a or b or c)]
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(tuple(dict.fromkeys(names)))
        self.mark.append(mark)
        self.letters.append(0)
        self.linked.append(0)
        return len(self.tag) - 1


def parse(source: str | None) -> Page:
    """The block tree and the blocks of text of a page. Silent elements and comments have no
    text; a missing end tag ends where HTML lets it end."""
    source = source or ""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", page.add("#root", -1, ""))]
    still_open: Counter[str] = Counter()
    silent, links = 0, 0
    run: list[str] = []
    owner, run_linked = 0, 0

    def flush() -> None:
        nonlocal run_linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                page.blocks.append((owner, text))
                page.letters[owner] += len(text)
                page.linked[owner] += min(run_linked, len(text))
        run_linked = 0

    def pop_to(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            name, _ = stack.pop()
            still_open[name] -= 1
            silent -= name in SILENT
            links -= name == "a"

    def close(names: set[str], until: set[str]) -> None:
        """End the innermost open element of these names, unless one of ``until`` is further in."""
        if not any(still_open[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                return pop_to(depth)
            if stack[depth][0] in until:
                return

    at, end = 0, len(source)
    while at < end:
        tag = _TAG.search(source, at)
        stop = tag.start() if tag else end
        if stop > at and not silent:
            piece = source[at:stop]
            run.append(piece)
            if links:
                run_linked += len(piece)
        if not tag:
            break
        at = max(tag.end(), stop + 1)
        if tag.group(1):
            name = tag.group(1).lower()
            if name in BLOCK:
                flush()
            close({name}, set())
            owner = stack[-1][1]
        elif tag.group(2):
            name, attributes = tag.group(2).lower(), tag.group(3)
            if name in BLOCK:
                flush()
                if name in KEEPS_P:
                    close({"p"}, {"table", "td", "th", "button", "object", "caption"})
                if name in CLOSES_ITSELF:
                    close(SAME_LEVEL.get(name, {name}), CLOSES_ITSELF[name])
            elif name == "br":
                run.append(" ")
            elif name == "body":
                pop_to(1)
            if name not in VOID and not attributes.rstrip().endswith("/") or name in BLOCK and name != "hr":
                node = page.add(name, stack[-1][1], attributes) if name in BLOCK and not silent else stack[-1][1]
                stack.append((name, node))
                still_open[name] += 1
                silent += name in SILENT
                links += name == "a"
                if name in RAW:  # the text up to the end tag is not markup
                    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = found.start() if found else end
            owner = stack[-1][1]
    flush()
    return page


def _bucket(n: int) -> int:
    return min(10, n.bit_length())


def features(page: Page) -> list[list[str]]:
    """What can be seen of each block element: tag, parts of its names, text of its own and below it."""
    n = len(page.tag)
    below, linked, kids = page.letters[:], page.linked[:], [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        below[p] += below[i]
        linked[p] += linked[i]
        kids[p] += 1
    ends = {}
    for node, text in page.blocks:
        ends[node] = ends.get(node, False) or text[-1] in ".!?:;\"'”»…"
    out = []
    for i in range(n):
        share = 4 * linked[i] // max(1, below[i])
        own = f"own {_bucket(page.letters[i])} {ends.get(i, '')}"
        row = ["tag " + page.tag[i], own, f"below {_bucket(below[i])}", f"share {share}", f"kids {_bucket(kids[i])}"]
        out.append(row + ["name " + name for name in page.names[i]])
    return out


def marked_labels(page: Page) -> list[int]:
    """Labels from ``data-content`` marks, handed down."""
    labels: list[int] = []
    for i, mark in enumerate(page.mark):
        labels.append(int(mark) if mark else labels[page.parent[i]] if i else 0)
    return labels


NOT_ARTICLE = frozenset("nav aside footer form menu".split())
NOT_ARTICLE_NAMES = {frozenset(_PART.findall(name)) for name in (*COMMENTS, *ADVERT, *NOTICE)}


def article_labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup names one article; None for other pages."""
    if page.tag.count("article") != 1:
        return None
    labels: list[int] = []
    for i, tag in enumerate(page.tag):
        other = tag in NOT_ARTICLE or not i or any(name.issubset(page.names[i]) for name in NOT_ARTICLE_NAMES)
        labels.append(1 if tag == "article" else 0 if other else labels[page.parent[i]])
    return labels


@dataclass(frozen=True)
class Model:
    """Log-odds of content for each feature; chances of content given the parent's label (0 or 1), for
    the tags of parent and child and for any other pair of tags; the chance at the root."""

    odds: dict[str, float]
    given: dict[tuple[str, str], tuple[float, float]]
    other: tuple[float, float]
    root: float

    def edges(self, page: Page) -> list[tuple[float, float]]:
        tag = page.tag
        return [self.other, *[self.given.get((tag[p], tag[i]), self.other) for i, p in enumerate(page.parent) if p >= 0]]

    def marginals(self, page: Page) -> list[float]:
        """Chance of content for each block element: one pass up, one down."""
        n, parent = len(page.tag), page.parent
        odds, edges = self.odds, self.edges(page)
        up0, up1 = [1.0] * n, [1.0] * n  # potential times the messages of the children
        to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
        for i, row in enumerate(features(page)):
            up1[i] = math.exp(max(-30.0, min(30.0, sum([odds.get(f, 0.0) for f in row]))))
        for i in range(n - 1, -1, -1):
            total = up0[i] + up1[i]
            a, b = up0[i] / total, up1[i] / total
            up0[i], up1[i] = a, b
            t0, t1 = edges[i]
            m0, m1 = (1 - t0) * a + t0 * b, (1 - t1) * a + t1 * b
            to0[i], to1[i] = m0, m1
            p = parent[i]
            if p >= 0:
                x, y = up0[p] * m0, up1[p] * m1
                scale = x + y
                up0[p], up1[p] = x / scale, y / scale
        out = [0.0] * n
        for i in range(n):
            if i:  # what the parent says without this child, through the edge
                p, (t0, t1) = parent[i], edges[i]
                a, b = (1 - out[p]) / to0[i], out[p] / to1[i]
                d0, d1 = a * (1 - t0) + b * (1 - t1), a * t0 + b * t1
            else:
                d0, d1 = 1 - self.root, self.root
            x, y = d0 * up0[i], d1 * up1[i]
            out[i] = y / (x + y)
        return out

    def text(self, source: str | None) -> str:
        """The blocks kept, one per line."""
        page = parse(source)
        if set(page.tag) <= {"#root", "html", "body"}:  # text without any block is nothing but text
            return "\n".join(text for _, text in page.blocks)
        chance = self.marginals(page)
        return "\n".join(text for node, text in page.blocks if chance[node] > 0.5)


def fit(labelled: list[tuple[Page, list[int]]]) -> Model:
    """Counts of features by label and of labels by the parent's label, smoothed; pairs of tags
    lean on all pairs as if SMOOTH more edges had been seen."""
    seen, nodes, roots = (Counter(), Counter()), [0, 0], [1, 1]
    pairs: dict[tuple[str, str], list[list[int]]] = {}
    for page, labels in labelled:
        for i, row in enumerate(features(page)):
            y = labels[i]
            nodes[y] += 1
            seen[y].update(row)
            if i:
                p = page.parent[i]
                pairs.setdefault((page.tag[p], page.tag[i]), [[0, 0], [0, 0]])[labels[p]][y] += 1
            else:
                roots[y] += 1
    odds = {
        f: TEMPER * (math.log((seen[1][f] + 0.5) / (nodes[1] + 1)) - math.log((seen[0][f] + 0.5) / (nodes[0] + 1)))
        for f in seen[0].keys() | seen[1].keys()
    }
    every = [[1 + sum(n[x][y] for n in pairs.values()) for y in (0, 1)] for x in (0, 1)]
    other = tuple(n[1] / sum(n) for n in every)
    given = {k: tuple((n[x][1] + SMOOTH * other[x]) / (sum(n[x]) + SMOOTH) for x in (0, 1)) for k, n in pairs.items()}
    return Model(odds, given, other, roots[1] / sum(roots))


def _sampled(pages: DataFrame, limit: int) -> list[str]:
    """At most ``limit`` pages with an article: those of the smallest hashes of their ids, pages with one article tag first.

    The ids are chosen before any page is read for the sample. Ids above a hash that about four times ``limit`` ids stay below are left out in
    the tasks, so what reaches the driver does not grow with the table. A repeated id counts once.
    """
    articles = F.regexp_count("html", F.lit(r"(?i)<article[\s/>]"))
    usable = pages.select("page_id", "html", articles.alias("articles")).filter("articles > 0 and page_id is not null")
    key = F.md5(F.col("page_id").cast("string"))
    several = F.col("articles") > 1
    keyed = usable.select("page_id", several.alias("several"), key.alias("key"), F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("hash"))
    counts = {row["several"]: row["n"] for row in keyed.groupBy("several").agg(F.approx_count_distinct("key").alias("n")).collect()}
    ids: list = []
    for kind in (False, True):
        share = 1 << 32
        if counts.get(kind, 0) > 8 * limit:
            share = (4 * limit + 100) * (1 << 32) // counts[kind]
        wanted = limit - len(ids)
        if wanted > 0 and counts.get(kind):
            few = keyed.filter((F.col("several") == kind) & (F.col("hash") < share)).select("key", "page_id").distinct()
            ids += [row["page_id"] for row in few.orderBy("key", "page_id").limit(wanted).collect()]
    chosen = usable.join(F.broadcast(pages.sparkSession.createDataFrame([(i,) for i in ids], usable.select("page_id").schema)), "page_id")
    return [row["html"] for row in chosen.groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()]


def train(pages: DataFrame, limit: int = SAMPLE) -> Model:
    """A model from the built layouts and at most ``limit`` pages of the table with an article (see ``_sampled``)."""
    labelled = [(page, marked_labels(page)) for page in map(parse, labelled_pages())]
    for html in _sampled(pages, limit):
        page = parse(html)
        labels = article_labels(page)
        if labels:
            labelled.append((page, labels))
    return fit(labelled)


def main_text(source: Column, model: Model) -> Column:
    """Main text of a page; empty for null, empty pages and pages without content."""

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([model.text(s) for s in column.to_pylist()], pa.string())

    return F.arrow_udf(work, "string").asNondeterministic()(source)
