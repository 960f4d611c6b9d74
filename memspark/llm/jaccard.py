"""N-gram Jaccard join: which texts share 80 % of their word shingles, as components.

Sets are compared inside size-banded tiles. A band holds the sets whose larger partner has
between B/2 and B shingles. Similar sets of a band differ in at most D shingles; so when the hash values
are cut into more than D ranges (the parts), two similar sets agree on a whole part. A tile holds
the sets of a band that agree on one part. No similar pair is outside the tiles, and sets that
merely share a common passage rarely agree on a part, because other shingles fall
between those of the passage.

Inside the tiles:

1. Sets that are equal are one node from the start, whatever the number of copies.
2. Every node is held against the node that leads most of its tiles, and components of the links are found.
   Tiles that still hold several components get another lead, as long as that links many nodes; each turn costs
   a comparison for every node outside the lead's component, so a group of very many near copies
   becomes one component after a number of comparisons that grows with its size, not with the square.
3. What still shares a tile across components is compared in blocks by bitmaps: first the closest pair of
   every two components is checked, then all pairs that are left. So every pair that
   shares a tile is in one component or has been compared. The texts of a pair are compared once.

A comparison counts the differing bits of two bitmaps (each shingle flips one bit). That count is at most the
number of shingles in one set only, so it bounds the overlap from above. Pairs that it does not
rule out are checked by intersecting the sorted sets of the two texts.

Hot tiles: a part shared by more than one set in HOT_PARTS (found on a hash sample of the sets, which only
steers the work) is spread by node over all tasks; other tiles meet in the task of their part.
Sets are known by a 64-bit hash of their shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.components import SMALL, components
from memspark.llm.memory import tidy
from memspark.llm.words import mix, shingle_sets, slices, utf8
from memspark.sources.scratch import Workspace

WORDS = 5
PERCENT = 80
SEEDS = 3
ENTRIES = 1_000_000  # tile entries per task
BLOCK = 256  # nodes compared at once
TURNS = 5  # other leads that are tried, at most
WORTH = 0.2  # share of similar pairs in a turn from which another one is taken
FEW_PAIRS = 100_000
BITMAP_PAIRS = 10_000  # compared by their bitmaps in a task, about
TEXT_PAIRS = 500  # compared by their texts in a task, about
BLOCK_ROWS = 5_000  # rows of tiles in a task that compares blocks, about
BLOCK_PAIRS = 2_000_000  # pairs of nodes that share a tile in such a task, about
PROBE = 256  # one set in so many shows which parts are hot
HOT_PARTS = 500
HOT_LEAST = 50

_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def differing(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The most shingles in only one of two similar sets with ``total`` shingles together."""
    return (100 - percent) * total // (100 + percent)


def _per_set(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def node_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mix(_per_set(mix(values ^ _A), offsets) + np.diff(offsets).astype(np.uint64) * _B).view(np.int64)


def _bits(n: np.ndarray) -> np.ndarray:
    """Bitmap length: a power of two, at least twice the size of the set."""
    return 2 ** np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1)


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    out = []
    for i, m in enumerate(_bits(np.diff(offsets)).tolist()):
        own = (values[offsets[i] : offsets[i + 1]] & np.uint64(m - 1)).astype(np.int64)
        out.append(np.packbits((np.bincount(own, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def _fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (last axis: 64-bit words) made as short as that of a smaller set."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def may_link(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes with ``apart`` differing bits can be similar."""
    most = (n_a + n_b - apart) // 2  # shingles in both, at most
    most = np.minimum(most, np.minimum(n_a, n_b))
    return 100 * most >= percent * (n_a + n_b - most)


def signatures(values: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of the tiles of every set."""
    n = np.diff(offsets)
    some = np.maximum(n, 1)
    own = np.ceil(np.log2(some)).astype(np.int64)
    upper = np.ceil(np.log2(np.maximum(some * 100 // percent, 1))).astype(np.int64)
    rows, keys = [], []
    for extra in range(int((upper - own).max(initial=0)) + 1):
        sets = np.flatnonzero((n > 0) & (own + extra <= upper))
        _tiles(values, offsets, sets, 2 ** (own[sets] + extra), percent, 0, rows, keys)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _tiles(values, offsets, sets, band, percent, seed, rows, keys) -> None:
    """Tiles of some sets in one band each.

    Parts with one shingle are frequent in many sets, and empty ones in all. They are needed
    only for sets in which too few other parts are left to hold one that cannot differ. A set short of
    parts that are not empty is cut again with another seed; after the last one its empty parts count too.
    The rule looks at one set alone, and holds for a pair as soon as it holds for one of the two.
    """
    if not len(sets):
        return
    n = np.diff(offsets)[sets]
    local = np.repeat(np.arange(len(sets)), n)
    at = np.arange(len(local)) + np.repeat(offsets[sets] - (np.cumsum(n) - n), n)
    value = values[at]
    if seed:
        value = mix(value ^ np.uint64(int(_A) * seed % 2**64))
        order = np.lexsort((value, local))
        value = value[order]
    most_apart = differing(2 * band, percent)
    parts = most_apart + 1 + most_apart // 8
    allowed = differing(n + np.minimum(band, n * 100 // percent), percent)
    part = ((value >> np.uint64(32)) * parts[local].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(value), bool)
    new[1:] = (local[1:] != local[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    edges = np.append(first, len(value))
    length, owner, piece = np.diff(edges), local[first], part[first]
    sums = _per_set(mix(value + _C), edges)
    base = mix(band.astype(np.uint64) * _A + np.uint64(seed))
    key = mix(sums + mix(piece + base[owner]) + length.astype(np.uint64) * _B)
    large = np.bincount(owner[length > 1], minlength=len(sets)) > allowed
    keep = (length > 1) | ~large[owner]
    rows.append(sets[owner[keep]])
    keys.append(key[keep])
    short = np.flatnonzero(np.bincount(owner, minlength=len(sets)) <= allowed)
    if not len(short):
        return
    if seed + 1 < SEEDS:
        _tiles(values, offsets, sets[short], band[short], percent, seed + 1, rows, keys)
        return
    for i in short.tolist():
        empty = np.setdiff1d(np.arange(parts[i]), piece[owner == i].astype(np.int64)).astype(np.uint64)
        rows.append(np.full(len(empty), sets[i]))
        keys.append(mix(mix(empty + base[i])))


# -- passes over texts --------------------------------------------------------

SETS_DDL = "n long, node long, bitmap binary, probe array<long>"
_SETS = pa.schema([("n", pa.int64()), ("node", pa.int64()), ("bitmap", pa.binary()), ("probe", pa.list_(pa.int64()))])


def _sets_column(text, words: int, percent: int):
    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        values, offsets = shingle_sets(*utf8(part.column("text")), words)
        n, node = np.diff(offsets), node_ids(values, offsets)
        row, key = signatures(values, offsets, percent)
        probe = [None] * len(n)
        for i in np.flatnonzero((n > 0) & (node.view(np.uint64) % np.uint64(PROBE) == 0)).tolist():
            probe[i] = key[row == i].view(np.int64)
        none = pa.array(n == 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(n, pa.int64()),
                pa.array(node, pa.int64(), mask=n == 0),
                pa.array([b if k else None for b, k in zip(bitmaps(values, offsets), n.tolist())], pa.binary()),
                pa.array(probe, pa.list_(pa.int64())),
            ],
            schema=_SETS,
        )

    @tidy
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.record_batch([column], ["text"])
            parts = [of(part) for part in slices(batch, "text")]
            table = pa.Table.from_batches(parts, _SETS).combine_chunks()
            columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns]
            yield pa.StructArray.from_arrays(columns, fields=list(_SETS))

    return F.arrow_udf(work, SETS_DDL).asNondeterministic()(text)


def _entries(docs: DataFrame, words: int, percent: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, hot, sigs, nodes): the tile entries of all sets, packed by bucket.

    A bucket is a range of tile keys; the rest of a key (32 bits) goes into ``sigs``. Entries of hot
    tiles keep their whole key, and their bucket follows from the node.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(*utf8(part.column("text")), words)
                node = node_ids(values, offsets)
                if len(seen) > 1_000_000:
                    seen.clear()
                fresh = np.zeros(len(node), bool)  # equal sets are sent once per task
                for i, key in enumerate(node.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                row, key = signatures(values, offsets, percent)
                keep = fresh[row]
                owner, key = node[row[keep]], key[keep]
                is_hot = np.isin(key, hot)
                by = np.where(is_hot, mix(owner.view(np.uint64)), key)
                bucket = ((by >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.lexsort((bucket, is_hot))
                owner, key, is_hot, bucket = owner[order], key[order], is_hot[order], bucket[order].astype(np.int32)
                change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(is_hot.astype(np.int8)) != 0)) + 1
                edges = [0, *change.tolist(), len(key)] if len(key) else [0]
                out = [[], [], [], []]
                for a, b in zip(edges, edges[1:]):
                    out[0].append(int(bucket[a]))
                    out[1].append(bool(is_hot[a]))
                    out[2].append((key[a:b] if is_hot[a] else key[a:b].astype(np.uint32)).tobytes())
                    out[3].append(owner[a:b].tobytes())
                types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)], ["bucket", "hot", "sigs", "nodes"]
                )

    return docs.select("text").mapInArrow(work, "bucket int, hot boolean, sigs binary, nodes binary")


def _members(entries: DataFrame, tasks: int) -> DataFrame:
    """(tile, node, weight) of tiles with two nodes or more. Tiles with the same nodes are one
    tile; weight counts them. Hot tiles come as they are."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        names = ["tile", "node", "weight"]
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("bucket", "hot", "sigs", "nodes")]
            for bucket, hot, sigs, owners in zip(*columns):
                owner = np.frombuffer(owners, np.int64)
                if hot:
                    tile = np.frombuffer(sigs, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(owner), pa.array(np.ones(len(owner), np.int64))], names)
                else:
                    keys.append(np.frombuffer(sigs, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
                    nodes.append(owner)
        if not keys:
            return
        key, node = np.concatenate(keys), np.concatenate(nodes)
        del keys, nodes
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        alike = np.zeros(len(key) + 1, bool)
        alike[1:-1] = key[1:] == key[:-1]
        some = alike[1:] | alike[:-1]  # entries that are not alone in their tile
        key, node = key[some], node[some]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        edges = np.append(starts, len(key))
        size = np.diff(edges)
        whole = mix(_per_set(mix(node.view(np.uint64) + _C), edges) + size.astype(np.uint64) * _B)
        whole, size, starts = whole[size > 1], size[size > 1], starts[size > 1]
        tile, pick, weight = np.unique(whole, return_index=True, return_counts=True)
        for a in range(0, len(tile), 4096):
            chosen = pick[a : a + 4096]
            long = size[chosen]
            at = np.repeat(starts[chosen] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            out = [np.repeat(tile[a : a + 4096].view(np.int64), long), node[at], np.repeat(weight[a : a + 4096], long)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    spread = entries.repartition(tasks, "bucket")
    found = spread.mapInArrow(work, "tile long, node long, weight long")
    return found.groupBy("tile", "node").agg(F.sum("weight").alias("weight"))


# -- comparisons ----------------------------------------------------------------


def _rule_out(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs with sizes and bitmaps that the bitmaps do not rule out."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(name).to_pylist() for name in ("n_a", "n_b", "bitmap_a", "bitmap_b")]
            for n_a, n_b, left, right in zip(*columns):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum())
                keep.append(bool(may_link(n_a, n_b, apart, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(work, "a long, b long")


def _check(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: sorted sets are intersected. ``pairs`` is a written table.

    Up to FEW_PAIRS they are broadcast, so that only the texts in question are shuffled.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                sets: dict[int, np.ndarray] = {}
                for node, text in (("a", "text_a"), ("b", "text_b")):
                    ids = np.asarray(part.column(node))
                    _, first = np.unique(ids, return_index=True)
                    chosen = part.take(pa.array(first))
                    values, offsets = shingle_sets(*utf8(chosen.column(text)), words)
                    for i, key in enumerate(ids[first].tolist()):
                        sets[key] = values[offsets[i] : offsets[i + 1]]
                keep = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                    x, y = sets[a], sets[b]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    count = pairs.count()
    if count <= FEW_PAIRS:  # only the texts in question are shuffled, once
        both = _both(pairs, texts, ["text"], 1 + count // TEXT_PAIRS)
        return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")
    with_b = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    with_a = with_b.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return with_a.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _across(blocks: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of nodes of two blocks of a tile: other components, not ruled out by size or bitmap.

    ``best``: of every two components only the pair with the fewest differing bits.
    """

    def load(block):
        words = np.array([len(m) // 8 for m in block["bitmaps"]])
        maps = [np.frombuffer(m, np.uint64) for m in block["bitmaps"]]
        return np.array(block["nodes"]), np.array(block["labels"]), np.array(block["sizes"]), maps, words

    def near(one, two) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, label_a, n_a, maps_a, words_a = one
        _, label_b, n_b, maps_b, words_b = two
        for wa in np.unique(words_a).tolist():
            for wb in np.unique(words_b).tolist():
                i, j, words = np.flatnonzero(words_a == wa), np.flatnonzero(words_b == wb), min(wa, wb)
                x = _fold(np.stack([maps_a[k] for k in i]), words)
                y = _fold(np.stack([maps_b[k] for k in j]), words)
                height = max(1, (1 << 18) // (words * len(j)))
                for at in range(0, len(i), height):
                    rows = i[at : at + height]
                    apart = np.bitwise_count(x[at : at + height, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok = may_link(n_a[rows, None], n_b[None, j], apart, percent) & (label_a[rows, None] != label_b[None, j])
                    p, q = np.nonzero(ok)
                    if len(p):
                        yield rows[p], j[q], apart[p, q]

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "y", "a", "b", "apart"])

    def fewest(columns: list[np.ndarray]) -> list[np.ndarray]:
        """One row for each pair of components, or for each pair of nodes."""
        x, y, a, b, apart = columns
        order = np.lexsort((b, a, apart, y, x)) if best else np.lexsort((b, a))
        keys = (x[order], y[order]) if best else (a[order], b[order])
        first = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]))[: len(a)]
        return [c[order][first] for c in columns]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                one, two = load(row["left"]), load(row["right"])
                for i, j, apart in near(one, two):
                    a, b, x, y = one[0][i], two[0][j], one[1][i], two[1][j]
                    held.append([np.minimum(x, y), np.maximum(x, y), np.minimum(a, b), np.maximum(a, b), apart])
                    more += len(a)
                    if more > 200_000:  # several tiles give the same pairs
                        held = [fewest([np.concatenate(c) for c in zip(*held)])]
                        more = 0
                        if len(held[0][0]) > 500_000:
                            yield pairs(held.pop())
        if held:
            yield pairs(fewest([np.concatenate(c) for c in zip(*held)]))

    found = blocks.mapInArrow(work, "x long, y long, a long, b long, apart long")
    if best:
        closest = F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p")
        found = found.groupBy("x", "y").agg(closest).select("p.a", "p.b")
    return found.select("a", "b").distinct()


def _both(pairs: DataFrame, values: DataFrame, names: list[str], tasks: int) -> DataFrame:
    """Few ``pairs`` (a, b), which are broadcast, with the ``names`` of both nodes from ``values`` (node, names). At most ``tasks``
    tasks go on with them: a Python process for a few pairs costs more than the pairs."""
    ends = [F.struct(F.col(x).alias("node"), F.lit(x).alias("end")) for x in "ab"]
    met = values.join(F.broadcast(pairs.select("a", "b", F.inline(F.array(*ends)))), "node")
    found = [F.max(F.when(F.col("end") == x, F.col(name))).alias(f"{name}_{x}") for x in "ab" for name in names]
    return met.groupBy("a", "b").agg(*found).coalesce(tasks)


def _unchecked(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are not among those already ``checked``: what was found apart stays so."""
    return pairs.join(checked.select("a", "b").distinct(), ["a", "b"], "left_anti")


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Each pair once, as (a, b) with the smaller node first."""
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _blocks(mixed: DataFrame, percent: int) -> DataFrame:
    """Two blocks (left, right) of about BLOCK nodes of a tile at a time; blocks whose sizes are too far
    apart do not meet. ``mixed``: tile, node, label, n, bitmap, members."""
    share = F.ceil(F.col("members") / BLOCK)
    spread = mixed.withColumn("part", F.pmod(F.xxhash64("node"), share))
    column = {"nodes": "node", "labels": "label", "sizes": "n", "bitmaps": "bitmap"}
    rows = F.collect_list(F.struct(*[F.col(c).alias(k) for k, c in column.items()]))
    held = spread.groupBy("tile", "part").agg(rows.alias("r"), F.min("n").alias("low"), F.max("n").alias("high"))
    block = F.struct(*[F.col(f"r.{k}").alias(k) for k in column])
    one = held.select("tile", F.col("part").alias("p"), F.col("low").alias("l"), F.col("high").alias("h"), block.alias("left"))
    two = held.select("tile", "part", "low", "high", block.alias("right"))
    near = (F.col("p") <= F.col("part")) & (100 * F.col("h") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("l"))
    return one.join(two, "tile").filter(near).select("left", "right")


def components_of(docs: DataFrame, space: Workspace, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach. A text without words (null, empty
    or white space) has an empty set, is linked with nothing and is its own component. Repeated
    rows and equal texts are one set. An empty table gives an empty result.
    """
    found = _grouped(docs, space, words, percent)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, space: Workspace, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, label, component_id) for every row; ``label`` names the component and is null
    for texts without words."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    key = F.xxhash64("text").alias("text_key")
    found = docs.select("doc_id", key, _sets_column(F.col("text"), words, percent).alias("s"))
    sets = space.stage(found.select("doc_id", "text_key", "s.*"), "sets")
    # a row that has the text of the node: that of the smallest id
    source = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key"))
    nodes = sets.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), source.alias("source"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")
    )
    nodes = space.stage(nodes, "nodes")

    probes = sets.filter("probe is not null").groupBy("node").agg(F.first("probe").alias("probe"))
    known = probes.count()
    common = probes.select(F.explode("probe").alias("k")).groupBy("k").count()
    common = common.filter(F.col("count") >= max(HOT_LEAST, known / HOT_PARTS)).collect()
    hot = np.array([r["k"] for r in common], np.int64).view(np.uint64)
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # tile entries are fewer than 0.4 per shingle
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(0.4 * shingles / ENTRIES) + 1)

    members = space.stage(_members(_entries(docs, words, percent, 8 * tasks, hot), tasks), "members")
    # the lead of a tile is its node that shares the most tiles with others: the least edited of a group of near copies
    degrees = members.groupBy("node").agg(F.sum("weight").alias("degree"))
    lead = F.max_by("node", F.struct("degree", "node")).alias("lead")
    sizes = members.join(degrees, "node").groupBy("tile").agg(lead, F.count("*").alias("members")).filter("members > 1")
    in_tiles = space.stage(members.join(sizes, "tile"), "in_tiles")
    small = in_tiles.count() <= SMALL
    in_tiles = in_tiles.coalesce(1) if small else in_tiles
    used = space.stage(in_tiles.select("node").distinct().join(nodes, "node"), "used")
    in_use = used.count()
    short = used.select("node", "n", "bitmap")
    left, right = (short.withColumnsRenamed({"node": x, "n": f"n_{x}", "bitmap": f"bitmap_{x}"}) for x in "ab")

    wanted = used.select("node", F.col("source.doc_id").alias("id"), F.col("source.text_key").alias("key"))
    same_row = docs["doc_id"].eqNullSafe(wanted["id"]) & (F.xxhash64(docs["text"]) == wanted["key"])
    texts = docs.join(wanted, same_row).groupBy("node").agg(F.first("text").alias("text"))  # repeated rows
    texts = space.stage(texts, "texts")

    def unite(labels: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, float]:
        """The labels after the similar ones of these pairs are linked as well, and the share of similar pairs."""
        links = space.stage(_check(pairs, texts, words, percent), "links")
        share = links.count() / max(1, pairs.count())
        if labels is not None:
            if not share:
                return labels, share
            links = links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return components(space, links, "a", "b"), share

    def held_against(leads: DataFrame) -> DataFrame:
        """The pairs of every node with the lead of most of its tiles (tile, node, lead, weight)."""
        votes = leads.filter("node != lead").groupBy("node", "lead").agg(F.sum("weight").alias("weight"))
        lead = F.max_by("lead", F.struct("weight", -F.col("lead"))).alias("lead")
        pairs = _ordered(votes.groupBy("node").agg(lead), "node", "lead")
        # of a small table there are at most as many pairs as it has rows
        both = _both(pairs, short, ["n", "bitmap"], 1 + in_use // BITMAP_PAIRS) if small else pairs.join(left, "a").join(right, "b")
        return space.stage(_rule_out(both, percent), "pairs")

    label = F.coalesce("label", "node").alias("label")

    def mixed_tiles(labels: DataFrame, turn: int) -> DataFrame:
        """(tile, node, weight, members, label, lead, lead_label) of the tiles that hold several components;
        a hash that changes with ``turn`` picks the lead."""
        placed = in_tiles.drop("lead").join(labels, "node", "left").select("tile", "node", "weight", "members", label)
        pick = F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn)))
        tiles = placed.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y"), pick.alias("p")).filter("x != y")
        tiles = tiles.select("tile", F.col("p.node").alias("lead"), F.col("p.label").alias("lead_label"))
        mixed = space.stage(placed.join(tiles, "tile"), "mixed")
        return mixed.coalesce(1) if small else mixed

    checked = held_against(in_tiles)  # pairs of which the texts were compared
    labels, _ = unite(None, checked)
    for turn in range(TURNS):
        mixed = mixed_tiles(labels, turn)
        if mixed.isEmpty():
            break
        pairs = held_against(mixed.filter("label != lead_label"))
        labels, share = unite(labels, pairs)
        checked = checked.union(pairs)
        if share < WORTH:
            break
    for best in (True, False):
        mixed = mixed_tiles(labels, TURNS)
        if mixed.isEmpty():
            break
        size = mixed.agg(F.count("*").alias("rows"), F.sum("members").alias("pairs")).first()  # a tile counts its members for each
        tasks = 1 + size["rows"] // BLOCK_ROWS + size["pairs"] // BLOCK_PAIRS
        blocks = _blocks(mixed.join(short, "node"), percent).coalesce(tasks)
        pairs = space.stage(_unchecked(_across(blocks, percent, best), checked), "across")
        labels, _ = unite(labels, pairs)
        checked = checked.union(pairs)

    grouped = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", label)
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    answer = grouped.join(least, "label").select("node", "label", "component_id")
    rows = sets.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node")
    return rows.join(answer, "node", "left").drop("node")


def keep_first(docs: DataFrame, space: Workspace, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of every component, with all columns: the one of the smallest doc_id, rows without doc_id last.

    Rows that have the same doc_id and text are one document, of which one row stays. Where the smallest doc_id stands for several
    texts of a component, the one with the smallest hash stays. A text without words is a component of its own.
    """
    found = space.stage(_grouped(docs.select("doc_id", "text"), space, words, percent), "grouped")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_key")
    first = first.unionByName(found.filter("label IS NULL").select("doc_id", "text_key").distinct())
    kept = space.stage(first.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")), "kept")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.kept_id")) & F.xxhash64("a.text").eqNullSafe(F.col("b.kept_key"))
    held = docs.alias("a").join(kept.alias("b"), same, "left_semi")
    repeated = found.groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    repeated = space.stage(repeated, "repeated")
    if repeated.isEmpty():
        return held
    single = held.alias("a").join(repeated.alias("b"), same, "left_anti")
    several = held.alias("a").join(repeated.alias("b"), same, "left_semi")
    # one row of each, taken whole; parts combine before the shuffle, so a row that is very often there is no hot key
    one = several.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.first(F.struct(*[several[c] for c in docs.columns])).alias("row"))
    return single.unionByName(one.select("row.*"))
