"""Removal of passages that an earlier document has, by windows of words that double in length.

Words are runs of characters other than white space (U+0020, U+0009 to U+000D), taken as they are. Windows of
FIRST words are looked up in all documents. Only those that more than one document has are extended to
twice the length (the last length is cut to the one asked for), and so on until that length is reached or no
candidate is left: a long window can only be repeated if the two shorter ones that make it up are. At
the last length the smallest doc_id that has a window is found. Every word covered by a window that also starts in a
document with a smaller doc_id is removed. All windows are judged on the input.

How it runs. Documents are dealt into blocks of some megabytes and written once, bucketed by block, so that
no later step moves a text. For each length every block sends its distinct candidate windows (64-bit names,
sorted) to ranges of names; a range answers each block with one bit per name. A window that holds
a third of all documents is sent once per block, so no key is hot. Before the last length 32 bits
of a name are sent, as a wrong "repeated" only costs a candidate; at the last length all bits, with the smallest
doc_id of the block. Two different windows share a name with a probability of 2^-64 for each pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.words import SEPARATOR, Words, mix, utf8
from memspark.sources.scratch import Workspace

WORDS = 13
FIRST = 7  # twice this is the first length of WORDS or more
BLOCK = 4 << 20  # bytes of text in a block, about; a longer text is a block with its neighbours
RANGE = 2_000_000  # names in a range, about
BUCKET = 64 << 20  # bytes of the table in a bucket, about
LAST_ID = np.iinfo(np.int64).max  # stands for no doc_id

_JOIN = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD1B54A32D192ED03)

MESSAGE = "block long, range long, n int, names binary, ids binary, place binary"
ANSWER = "block long, level int, range long, n int, bits binary"


def lengths(words: int = WORDS, first: int = FIRST) -> list[int]:
    """first, twice that and so on, the last one cut to ``words``."""
    out = [min(first, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


class _Names:
    """The distinct names of candidate windows in one block: sorted, with the smallest and largest doc_id of each."""

    def __init__(self, value: np.ndarray, ids: np.ndarray):
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        start = np.flatnonzero(new)
        self.value = ranked[start]
        self.inverse = np.empty(len(value), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        held = ids[order]
        self.least = np.minimum.reduceat(held, start) if len(start) else held
        self.most = np.maximum.reduceat(held, start) if len(start) else held

    def ranges(self, count: int) -> np.ndarray:
        """The range of each name, rising."""
        return (((self.value >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


class _Block:
    """Words of a block and, length by length, which of its windows are still candidates."""

    def __init__(self, table: pa.Table, sizes: list[int]):
        self.data, self.offsets = utf8(table.column("text"))
        self.words = Words(self.data, self.offsets, lower=False)
        ids = table.column("doc_id").combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.sizes = ids[self.words.doc], sizes
        self.at, self.value = self.words.windows(sizes[0])
        self.names = _Names(self.value, self.ids[self.at])

    def extend(self, level: int, bits: np.ndarray) -> None:
        """Keep the windows that are repeated, by the answer or inside the block, and go on to the next length."""
        n, shift = len(self.words.hash), self.sizes[level + 1] - self.sizes[level]
        repeated = bits | (self.names.least != self.names.most)
        alive, value = np.zeros(n + shift, bool), np.zeros(n, np.uint64)
        alive[self.at] = repeated[self.names.inverse]
        value[self.at] = self.value
        at = np.flatnonzero(alive[:n] & alive[shift:])
        self.at = at[self.words.doc[at] == self.words.doc[at + shift]]
        self.value = mix(value[self.at] * _JOIN + mix(value[self.at + shift] ^ _TURN))
        self.names = _Names(self.value, self.ids[self.at])

    def messages(self, block: int, count: int, last: bool) -> pa.Table:
        """The names for each range that has some."""
        of = self.names.ranges(count)
        cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else np.zeros(1, int)
        rows: dict[str, list] = {name: [] for name in ("range", "n", "names", "ids", "place")}
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            value = self.names.value[a:b]
            rows["range"].append(int(of[a]))
            rows["n"].append(b - a)
            if last:
                ids, place = np.unique(self.names.least[a:b], return_inverse=True)
                small = np.uint16 if len(ids) <= 1 << 16 else np.uint32
                rows["names"].append(value.tobytes())
                rows["ids"].append(ids.tobytes())
                rows["place"].append(place.astype(small).tobytes())
            else:
                rows["names"].append(value.astype(np.uint32).tobytes())
                rows["ids"].append(None)
                rows["place"].append(None)
        kinds = {"range": pa.int64(), "n": pa.int32(), "names": pa.binary(), "ids": pa.binary(), "place": pa.binary()}
        columns = {name: pa.array(values, kinds[name]) for name, values in rows.items()}
        return pa.table({"block": pa.array([block] * len(rows["n"]), pa.int64()), **columns})

    def kept(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Per row the number of words, the number of removed ones, and the others joined by one space."""
        n, rows = len(self.words.hash), len(self.offsets) - 1
        gone = bits[self.names.inverse] | (self.ids[self.at] > self.names.least[self.names.inverse])
        start = self.at[gone]
        change = np.bincount(start, minlength=n + 1) - np.bincount(start + self.sizes[-1], minlength=n + 1)
        stays = np.cumsum(change[:n]) == 0
        removed = np.bincount(self.words.doc[~stays], minlength=rows)

        opens, closes = _places(self.data, self.offsets)
        kept = np.flatnonzero(stays)
        doc = self.words.doc[kept]
        last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        stop = closes[kept] + ~last  # with the white space after the word, if another kept word follows
        text = self.data.copy()
        text[closes[kept[~last]]] = 0x20
        inside = np.bincount(opens[kept], minlength=len(text) + 1) - np.bincount(stop, minlength=len(text) + 1)
        out = text[np.cumsum(inside[: len(text)]) > 0]
        sizes = np.bincount(doc, weights=stop - opens[kept], minlength=rows).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        strings = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())
        return self.words.count, removed, strings


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)  # texts begin here
    edge[offsets] = True
    before, after = np.append(False, inside)[: len(data)], np.append(inside, False)[1 : len(data) + 1]
    opens = inside & (~before | edge[:-1])
    closes = inside & (~after | edge[1:])
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text): the rows as they stand, dealt into blocks by their place in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            if batch.num_rows:
                block = pa.array(base + (done + offsets[:-1]) // BLOCK, pa.int64())
                yield pa.RecordBatch.from_arrays([block, *batch.columns], ["block", "doc_id", "text"])
                done += int(offsets[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "block long, doc_id long, text string")


def _answers(answer: pa.Table, level: int) -> np.ndarray:
    """The bits for the names of a block at one length, in the order of the names."""
    rows = answer.filter(pc.equal(answer.column("level"), level)).sort_by("range")
    sizes, bits = rows.column("n").to_pylist(), rows.column("bits").to_pylist()
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in zip(sizes, bits)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _answer(level: int, last: bool):
    """For all names of a range: whether another block has the name; at the last length, whether one has it in a smaller doc_id."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        names = [np.frombuffer(v, np.uint64 if last else np.uint32) for v in table.column("names").to_pylist()]
        value = np.concatenate(names)
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if last:
            ids = []
            for one, place in zip(table.column("ids").to_pylist(), table.column("place").to_pylist()):
                known = np.frombuffer(one, np.int64)
                ids.append(known[np.frombuffer(place, np.uint16 if len(known) <= 1 << 16 else np.uint32)])
            held = np.concatenate(ids)[order]
            found = held > np.minimum.reduceat(held, start)[group]
        else:
            found = (np.diff(np.append(start, len(ranked))) > 1)[group]
        bits = np.empty(len(value), bool)
        bits[order] = found
        ends = np.cumsum(sizes)
        packed = [np.packbits(bits[e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
        return pa.table(
            {
                "block": table.column("block"),
                "level": pa.array([level] * len(sizes), pa.int32()),
                "range": table.column("range"),
                "n": table.column("n"),
                "bits": pa.array(packed, pa.binary()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, space: Workspace, words: int = WORDS, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs`` (doc_id, text); other columns are not read.

    ``kept`` joins the words that stay by one space. A null or empty text has no words and an empty ``kept``; a text
    with fewer than ``words`` words keeps all. Rows with the same doc_id remove nothing from each other. Rows without doc_id
    come after all others and count as one document. An empty table gives an empty result. Memory follows BLOCK
    or the longest text.
    """
    spark = docs.sparkSession
    sizes = lengths(words, first)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, total // (6 * RANGE))  # a word and its space take 6 bytes or more in most texts
    name = f"memspark_{uuid.uuid4().hex}"
    dealt = _blocks(docs).write.format("parquet").option("path", space.path("blocks")).option("compression", "zstd")
    dealt.bucketBy(max(partitions, total // BUCKET), "block").saveAsTable(name)
    try:
        rows = spark.table(name).groupBy("block")
        answers: DataFrame | None = None
        for level in range(len(sizes)):
            messages = _sent(rows, answers, sizes, level, count)
            found = messages.groupBy("range").applyInArrow(_answer(level, level == len(sizes) - 1), ANSWER)
            found = space.stage(found, f"answers{level}")
            answers = found if answers is None else answers.unionByName(found)
            if found.isEmpty():  # no candidates
                break

        def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
            block = _Block(table, sizes)
            for level in range(len(sizes) - 1):
                block.extend(level, _answers(answer, level) if len(block.at) else np.zeros(0, bool))
            bits = _answers(answer, len(sizes) - 1)
            counts, removed, kept = block.kept(bits)
            columns = {"n_words": pa.array(counts), "n_removed": pa.array(removed), "kept": kept}
            return pa.table({"doc_id": table.column("doc_id"), **columns})

        both = rows.cogroup(answers.groupBy("block"))
        return space.stage(both.applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string"), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _sent(rows, answers: DataFrame | None, sizes: list[int], level: int, count: int) -> DataFrame:
    """The messages of all blocks at one length, given the answers for the shorter ones."""
    last = level == len(sizes) - 1

    if level == 0:

        def begin(table: pa.Table) -> pa.Table:
            return _Block(table, sizes).messages(table.column("block")[0].as_py(), count, last)

        return rows.applyInArrow(begin, MESSAGE)

    def go_on(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = _Block(table, sizes)
        for shorter in range(level):
            block.extend(shorter, _answers(answer, shorter))
        return block.messages(table.column("block")[0].as_py(), count, last)

    return rows.cogroup(answers.groupBy("block")).applyInArrow(go_on, MESSAGE)
