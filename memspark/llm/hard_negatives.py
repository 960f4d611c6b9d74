"""Hard negatives: rows of another label whose score with an anchor lies in a window below that of a positive.

Vectors are integers and a score is their inner product. With the lengths of two vectors a score is
a distance, so a window of scores is an annulus around the anchor. The search goes down a multiway
hyperplane tree: every node has split points, and a vector belongs to the nearest of them. For each split point
the node keeps the smallest and largest distance to the members of every sibling subtree; a subtree is
left out when the range around some split point cannot meet the annulus. Leaves are searched exactly.

The split points are fitted on a sample (about SAMPLE rows by hash of vec_id). Every row is placed in the tree, and the distance
ranges cover all rows, so nothing is approximate. A leaf is as many blocks of about BLOCK rows as it
needs, so equal vectors, however many, are spread over tasks. Queries travel in chunks of about CHUNK to the blocks of
the leaves that they can reach; a pair of query and row never becomes a row of a table, only the best of a block do.
Before a search each query looks into one block of its own leaf: what it finds there raises the least score it can still use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.sources.scratch import Workspace

POSITIVES, NEGATIVES = 5, 10
WAYS = 8  # split points of a node
SAMPLE = 8192  # rows on which the split points are fitted, about
LEAF = 1000  # rows for which a leaf is meant
BLOCK = 1000  # rows in a block of a leaf, about
CHUNK = 500  # queries in a chunk, about
DEPTH = 16
BOUND = 1 << 26  # components must be smaller than this, so that scores are exact
ENDLESS = 1 << 62  # a bound that no score reaches

_FLOAT_EXACT = 1 << 20


@dataclass
class Node:
    points: np.ndarray  # (ways, dim)
    children: list[int] = field(default_factory=list)  # a node, or -1 - leaf
    low: np.ndarray | None = None  # [split point, child]: least distance to the members of the child
    high: np.ndarray | None = None
    short: np.ndarray | None = None  # least and largest squared length in each child
    long: np.ndarray | None = None


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


class Tree:
    """The split points, and after ``with_ranges`` what every subtree holds."""

    def __init__(self, sample: np.ndarray, size: int, ways: int = WAYS):
        """``sample`` are distinct-enough vectors; a group of at most ``size`` of them is a leaf."""
        self.nodes: list[Node] = []
        self.leaves, self.ways, self.size = 0, ways, max(1, size)
        self.dim = sample.shape[1]
        self.root = self._grow(sample, 0)

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        points = self._split_points(rows) if len(rows) > self.size and depth < DEPTH else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        number = len(self.nodes)
        self.nodes.append(Node(points))
        nearest = np.argmin(_squares(rows, points), axis=1)
        self.nodes[number].children = [self._grow(rows[nearest == j], depth + 1) for j in range(len(points))]
        return number

    def _split_points(self, rows: np.ndarray) -> np.ndarray:
        """Points far from each other: each the one that is farthest from those before."""
        pool = rows[:: max(1, len(rows) // (64 * self.ways))]
        chosen = [0]
        nearest = _squares(pool, pool[:1])[:, 0]
        while len(chosen) < self.ways and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, _squares(pool, pool[chosen[-1:]])[:, 0])
        return pool[chosen]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        leaf = np.zeros(len(vectors), np.int64)
        for number, rows, nearest, _ in self._walk(vectors):
            for j, child in enumerate(self.nodes[number].children):
                if child < 0:
                    leaf[rows[nearest == j]] = -1 - child
        return leaf

    def _walk(self, vectors: np.ndarray):
        """(node, rows that come to it, the child each goes to, squared distances from the split points)."""
        stack = [(self.root, np.arange(len(vectors)))] if self.root >= 0 else []
        while stack:
            number, rows = stack.pop()
            squares = _squares(vectors[rows], self.nodes[number].points)
            nearest = np.argmin(squares, axis=1)
            yield number, rows, nearest, squares
            for j, child in enumerate(self.nodes[number].children):
                if child >= 0 and (nearest == j).any():
                    stack.append((child, rows[nearest == j]))

    def ranges(self, vectors: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, split point, child, least, largest squared distance); split point -1 stands for the origin."""
        lengths = (vectors * vectors).sum(1)
        for number, rows, nearest, squares in self._walk(vectors):
            for j in range(len(self.nodes[number].children)):
                mine = nearest == j
                if mine.any():
                    held = np.column_stack([lengths[rows[mine]], squares[mine]])
                    for i, (low, high) in enumerate(zip(held.min(0).tolist(), held.max(0).tolist())):
                        yield number, i - 1, j, low, high

    def with_ranges(self, rows: list[tuple]) -> Tree:
        """Take in the ranges of all rows; a child without any row is never gone to."""
        for node in self.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.short, node.long = np.full(m, np.inf), np.full(m, -np.inf)
        for number, i, j, low, high in rows:
            node = self.nodes[number]
            if i < 0:
                node.short[j], node.long[j] = low, high
            else:
                node.low[i, j], node.high[i, j] = np.sqrt(low), np.sqrt(high)
        return self

    def reach(self, vectors: np.ndarray, query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs that can hold a member in one of the query's windows.

        ``query`` numbers the vector of each window, which takes scores from ``lo`` to ``hi``.
        """
        if self.root < 0:
            return np.unique(query), np.zeros(len(np.unique(query)), np.int64)
        lo, hi = lo.astype(np.float64), hi.astype(np.float64)
        lengths = (vectors * vectors).sum(1)
        found_query, found_leaf = [], []
        stack = [(self.root, np.arange(len(query)))]
        while stack:
            number, windows = stack.pop()
            node = self.nodes[number]
            some = node.short < np.inf
            asked, at = np.unique(query[windows], return_inverse=True)
            apart = np.sqrt(_squares(vectors[asked], node.points))[:, :, None]  # query, split point, child
            low, high = np.where(some, node.low, 0.0)[None], np.where(some, node.high, 0.0)[None]
            least = np.maximum(np.maximum(low - apart, apart - high), 0.0).max(axis=1)[at]
            most = (apart + high).min(axis=1)[at]
            own = lengths[query[windows]][:, None]
            outer = own + np.where(some, node.long, 0.0) - 2.0 * lo[windows][:, None]
            inner = own + np.where(some, node.short, 0.0) - 2.0 * hi[windows][:, None]
            slack = 1e-6 * (1.0 + np.sqrt(own) + np.sqrt(np.where(some, node.long, 0.0)))
            outer, inner = np.sqrt(np.maximum(outer, 0.0)), np.sqrt(np.maximum(inner, 0.0))
            meets = some & (least <= outer + slack) & (most >= inner - slack)
            for j, child in enumerate(node.children):
                mine = windows[meets[:, j]]
                if not len(mine):
                    continue
                if child >= 0:
                    stack.append((child, mine))
                else:
                    who = np.unique(query[mine])
                    found_query.append(who)
                    found_leaf.append(np.full(len(who), -1 - child))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_query]), np.concatenate([none, *found_leaf])


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """Lists of ``dim`` integers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


@dataclass
class Index:
    """All rows in blocks of leaves: ``blocks`` (leaf, block, rows) and ``sizes`` (leaf, blocks), one row per leaf."""

    tree: Tree
    blocks: DataFrame
    sizes: DataFrame


def usable(rows: DataFrame) -> DataFrame:
    """The rows (vec_id, label, q) that take part, one for each vec_id.

    Left out are rows with a null id, label, vector or component, components of BOUND or more, and vectors of
    another width than most. Of rows with the same id the one with the smallest (label, q) stands for all.
    """
    small = F.forall("q", lambda x: F.coalesce(F.abs(x) < BOUND, F.lit(False)))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull()
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("q").cast("array<int>")).filter(known & small)
    widths = rows.groupBy(F.size("q").alias("dim")).count().orderBy(F.desc("count"), "dim")
    widest = widths.first()
    rows = rows.filter(F.size("q") == (widest["dim"] if widest else 0)).filter(F.size("q") > 0)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")


def build(rows: DataFrame, space: Workspace, sample: int = SAMPLE, leaf: int = LEAF) -> Index | None:
    """The index of usable rows, which should be staged; None without rows."""
    total = rows.count()
    if not total:
        return None
    share = min(1 << 20, -(-(sample << 20) // total))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("q").toArrow()
    if not drawn.num_rows:  # a few rows, none of them drawn
        drawn = rows.select("q").limit(sample).toArrow()
    column = drawn.column("q").combine_chunks()
    dim = len(column[0])
    vectors = np.unique(_matrix(column, dim), axis=0)
    tree = Tree(vectors, max(1, leaf * drawn.num_rows // total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tree.place(_matrix(batch.column("q"), dim))
            yield batch.append_column("leaf", pa.array(found))

    placed = space.stage(rows.select("vec_id", "label", "q").mapInArrow(place, "vec_id long, label int, q array<int>, leaf long"), "placed")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            for *key, low, high in tree.ranges(_matrix(batch.column("q"), dim)):
                a, b = best.get(tuple(key), (low, high))
                best[tuple(key)] = (min(a, low), max(b, high))
        if best:
            columns = list(zip(*[(*key, *value) for key, value in best.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "split", "child", "low", "high"])

    # as many rows as the tree has pairs of split point and sibling
    held = placed.select("q").mapInArrow(ranges, "node long, split long, child long, low double, high double")
    held = held.groupBy("node", "split", "child").agg(F.min("low"), F.max("high")).collect()
    tree = tree.with_ranges([tuple(r) for r in held])
    sizes = space.stage(placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block")
    dealt = placed.join(F.broadcast(sizes), "leaf").select("leaf", block, "vec_id", "label", "q")
    members = F.sort_array(F.collect_list(F.struct("vec_id", "label", "q"))).alias("rows")
    return Index(tree, space.stage(dealt.groupBy("leaf", "block").agg(members), "blocks"), sizes)


WINDOWS = "array<struct<tag:long,lo:long,hi:long>>"
QUERY = f"anchor long, label int, q array<int>, windows {WINDOWS}"


def _windows(queries: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The query, tag, least and largest score of each window."""
    column = queries.field("windows")
    flat = column.flatten()
    return (
        np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())),
        *[flat.field(name).to_numpy(zero_copy_only=False) for name in ("tag", "lo", "hi")],
    )


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows."""
    limit = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if limit < _FLOAT_EXACT and a.shape[1] <= 4096:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best_of(queries: pa.StructArray, rows: pa.StructArray, dim: int, same: bool, k: int):
    """(anchor, tag, vec_id, score) of the best ``k`` rows of a block for each window."""
    query, tag, lo, hi = _windows(queries)
    anchor = queries.field("anchor").to_numpy(zero_copy_only=False)
    ids = rows.field("vec_id").to_numpy(zero_copy_only=False)
    labels, own = (x.field("label").to_numpy(zero_copy_only=False) for x in (rows, queries))
    scores = _scores(_matrix(queries.field("q"), dim, np.int64), _matrix(rows.field("q"), dim, np.int64))
    fits = ((own[:, None] == labels[None, :]) == same) & (anchor[:, None] != ids[None, :])
    for at in range(0, len(query), 512):
        w = np.arange(at, min(at + 512, len(query)))
        score = scores[query[w]]
        good = fits[query[w]] & (score >= lo[w][:, None]) & (score <= hi[w][:, None])
        score = np.where(good, score, -ENDLESS)
        if score.shape[1] > k:
            kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k]
            good &= score >= kth[:, None]
        window, row = np.nonzero(good)
        value = score[window, row]
        order = np.lexsort((ids[row], -value, window))
        window, row, value = window[order], row[order], value[order]
        first = np.searchsorted(window, window, side="left")
        keep = np.arange(len(window)) - first < k
        window, row, value = window[keep], row[keep], value[keep]
        yield anchor[query[w][window]], tag[w][window], ids[row], value


def _scan(index: Index, packed: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, tag, vec_id, score, rank): the best ``k`` of every window among the blocks that ``packed`` (leaf, block, queries) names."""
    dim = index.tree.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in range(batch.num_rows):
                queries, rows = (batch.column(name).slice(number, 1).flatten() for name in ("queries", "rows"))
                for columns in _best_of(queries, rows, dim, same, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "tag", "vec_id", "score"])

    pairs = packed.join(index.blocks, ["leaf", "block"]).select("queries", "rows")
    found = pairs.mapInArrow(run, "anchor long, tag long, vec_id long, score long")
    order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, space: Workspace, same: bool, k: int) -> DataFrame:
    """(anchor, tag, vec_id, score, rank) for ``queries`` (QUERY, staged, unique anchors).

    For each window the first ``k`` rows by (highest score, smallest vec_id) that have the label of the query
    (``same``) or another one, and a score from ``lo`` to ``hi``; the row of the anchor itself is not found.
    """
    tree, dim = index.tree, index.tree.dim
    chunks = max(1, -(-queries.count() // CHUNK))
    chunk = F.pmod(F.xxhash64("anchor"), F.lit(chunks)).alias("chunk")
    names = ["anchor", "label", "q", "windows"]

    def gathered(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy("leaf", chunk).agg(F.collect_list(F.struct(*names)).alias("queries"))
        return packed.join(F.broadcast(index.sizes), "leaf")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.place(_matrix(batch.column("q"), dim))))

    at_home = gathered(queries.select(*names).mapInArrow(home, f"{QUERY}, leaf long"))
    one = at_home.withColumn("block", F.pmod(F.xxhash64("chunk"), F.col("blocks")))
    bounds = _scan(index, one, same, k).filter(F.col("rank") == k).groupBy("anchor").agg(F.collect_list(F.struct("tag", "score")).alias("known"))

    def raised(window, known):
        least = F.array_max(F.transform(F.filter(known, lambda b: b["tag"] == window["tag"]), lambda b: b["score"]))
        return F.struct(window["tag"].alias("tag"), F.greatest(window["lo"], least).alias("lo"), window["hi"].alias("hi"))

    tighter = queries.join(bounds, "anchor", "left").withColumn(
        "windows", F.transform("windows", lambda w: raised(w, F.coalesce("known", F.array().cast("array<struct<tag:long,score:long>>"))))
    )
    tighter = space.stage(tighter.select(*names), "bounded")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            query, _, lo, hi = _windows(rows)
            who, leaf = tree.reach(_matrix(batch.column("q"), dim), query, lo, hi)
            for at in range(0, len(who), 10_000):
                yield batch.take(pa.array(who[at : at + 10_000])).append_column("leaf", pa.array(leaf[at : at + 10_000]))

    goals = gathered(tighter.mapInArrow(reached, f"{QUERY}, leaf long"))
    every = goals.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _scan(index, every, same, k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    space: Workspace,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, q).

    An anchor is a row that takes part (see ``usable``) and for which the condition ``is_anchor`` holds. Its positives are its first
    ``positives`` other rows of the same label. For each of them the first ``negatives`` rows of other labels are given whose score is
    from ``least`` to ``most`` per cent of the positive's. Higher scores come first, ties by smaller vec_id. Anchors without
    positives or negatives give no rows, and so does an empty table.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = space.stage(usable(rows), "usable")
    index = build(rows, space)
    if index is None:
        return rows.sparkSession.createDataFrame([], result)
    anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor"), "label", "q")
    whole = F.array(F.struct(F.lit(0).alias("tag"), F.lit(-ENDLESS).alias("lo"), F.lit(ENDLESS).alias("hi"))).cast(WINDOWS)
    asked = space.stage(anchors.withColumn("windows", whole), "anchors")
    found = search(index, asked, space, True, positives)
    found = space.stage(found.select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("positive_score")), "positives")

    # the least and largest whole numbers within the percentages; division drops the fraction towards zero
    window = found.selectExpr(
        "anchor",
        "positive AS tag",
        f"IF(positive_score > 0, ({least} * positive_score + 99) DIV 100, ({least} * positive_score) DIV 100) AS lo",
        f"IF(positive_score > 0, ({most} * positive_score) DIV 100, -((99 - {most} * positive_score) DIV 100)) AS hi",
    ).filter("lo <= hi")
    windows = window.groupBy("anchor").agg(F.collect_list(F.struct("tag", "lo", "hi")).cast(WINDOWS).alias("windows"))
    asked = space.stage(anchors.join(windows, "anchor").select("anchor", "label", "q", "windows"), "windows")
    hits = search(index, asked, space, False, negatives)
    scored = hits.withColumnsRenamed({"tag": "positive", "score": "negative_score"}).join(found, ["anchor", "positive"])
    return scored.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast(T.IntegerType()).alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        "negative_score",
    )


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, as an array of ints; null unless all components are finite numbers within bounds."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * 256 < BOUND - 1, F.lit(False)))
    return F.when(fine, scaled).cast("array<int>")
