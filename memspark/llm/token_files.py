"""Token ids of documents as binary files, in the order of doc_id, and back.

A file holds whole documents in order:

    magic "MSTOK1\\0\\0", documents (u64), ids (u64), words (u64)
    doc_id of each document (i64) and one bit for a null id (bytes)
    ids of each document (u32), number of words before each block of ids (u32, one more than blocks)
    Simple-8b words (u64)

All numbers are little-endian. Documents are range-sorted by Spark; each task writes files of
about FILE_IDS ids named by its partition and a running number. Names and contents follow from
the rows, and a file appears under its name only when complete, so a task that runs again
after a lost executor leaves the same files. The table of files is written when all tasks are done.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.llm import simple8b
from memspark.llm.chunks import Memory, pack_ids
from memspark.llm.words import slices

MAGIC = b"MSTOK1\0\0"
FILE_IDS = 1 << 20
END = 2


class Encoder:
    """Whole texts to ids with the tokenizers library, each part of a text once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = Memory(self._parts)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """All parts in one call of the library, which tells the part that each id comes from."""
        coded = self.tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(parts))
        ends = 4 * np.cumsum(counts)
        ids = pack_ids(coded.ids)
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text begins."""
        return self.parts.ids(texts)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    words, offsets = simple8b.encode(ids)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], np.uint8))
    head = np.array([len(doc_ids), len(ids), len(words)], "<u8")
    parts = (head, known, null, counts.astype("<u4"), offsets.astype("<u4"), words.astype("<u8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ids of one file."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    documents, total, words = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    known = take("<i8", documents)
    null = np.unpackbits(take("u1", -(-documents // 8)), count=documents)
    counts = take("<u4", documents)
    offsets = take("<u4", -(-total // simple8b.BLOCK) + 1)
    ids = simple8b.decode(take("<u8", words), offsets, total)
    return [None if n else d for d, n in zip(known.tolist(), null.tolist())], counts, ids


FILES_DDL = "part int, number int, path string, documents long, ids long"


def write(docs: DataFrame, folder: str, path: str, end: int = END) -> DataFrame:
    """Rows of FILES_DDL, one per file written below ``folder``; evaluate the result once.

    Null text is the empty text: only the end id. Rows come in the order of doc_id (null first) and text,
    so repeated ids have a fixed order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        part, number = TaskContext.get().partitionId(), 0
        files, place = _open(folder)
        doc_ids, counts, ids, held = [], [], [], 0

        def save() -> pa.RecordBatch:
            nonlocal number, doc_ids, counts, ids, held
            name = f"{place}/part-{part:06d}-{number:06d}.s8b"
            data = pack(doc_ids, np.array(counts), np.concatenate(ids))
            files.create_dir(place)
            draft = f"{place}/_draft-{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write(data)
            files.move(draft, name)
            row = {"part": [part], "number": [number], "path": [name], "documents": [len(doc_ids)], "ids": [held]}
            number, doc_ids, counts, ids, held = number + 1, [], [], [], 0
            schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for rows in slices(batch, "text"):
                flat, starts = own.encode(rows.column("text"))
                flat = np.insert(flat, starts[1:], end)
                ends = starts[1:] + np.arange(1, len(starts))
                at = 0
                for doc_id, stop, n in zip(rows.column("doc_id").to_pylist(), ends.tolist(), (np.diff(starts) + 1).tolist()):
                    doc_ids.append(doc_id)
                    counts.append(n)
                    held += n
                    if held >= FILE_IDS:
                        ids.append(flat[at:stop])
                        at = stop
                        yield save()
                ids.append(flat[at:])
        if doc_ids:
            yield save()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(work, FILES_DDL)


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    # one row per file; a file has about FILE_IDS ids
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("file_start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    placed = placed.select("path", "file_start").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for batch in batches:
            for path, file_start in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist()):
                with store.open_input_stream(path) as source:
                    doc_ids, counts, ids = unpack(source.read())
                stop = np.cumsum(counts.astype(np.int64))
                flat = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(flat[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(file_start + stop - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
