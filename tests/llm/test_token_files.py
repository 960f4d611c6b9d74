"""Simple-8b round trips, and files against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from conftest_llm import make, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memspark.llm import simple8b, token_files

JSON = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(JSON)
LIBRARY.encode_special_tokens = True

ids = st.integers(0, 60).flatmap(lambda bits: st.integers(0, 2**bits - 1))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ids, st.integers(1, 70))))
def test_simple8b(runs):
    """Ids of up to 60 bits, alone and in runs of equal ones."""
    values = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    words, offsets = simple8b.encode(values)
    assert simple8b.decode(words, offsets, len(values)).tolist() == values.tolist()
    assert len(offsets) == -(-len(values) // simple8b.BLOCK) + 1 and offsets[-1] == len(words)


def test_words_are_full():
    """Small ids take few words; an escape takes one."""
    for value, n in [(1, 60), (3, 30), (50_000, 3), (2**15 - 1, 4), (2**30 - 1, 2), (2**31, 1), (2**60 - 1, 1)]:
        words, _ = simple8b.encode(np.full(n, value, np.uint64))
        assert len(words) == 1


def test_one_block_alone():
    """The offset of a block is all that its decoding needs."""
    values = np.random.default_rng(1).integers(0, 50_000, 1000).astype(np.uint64)
    words, offsets = simple8b.encode(values)
    for b in range(len(offsets) - 1):
        own = values[b * 128 : (b + 1) * 128]
        block = words[offsets[b] : offsets[b + 1]]
        assert simple8b.decode(block, np.array([0, len(block)], np.uint32), len(own)).tolist() == own.tolist()


def test_file():
    values = np.arange(0, 400, dtype=np.uint32)
    data = token_files.pack([5, None, -7], np.array([150, 0, 250]), values)
    doc_ids, counts, back = token_files.unpack(data)
    assert doc_ids == [5, None, -7] and counts.tolist() == [150, 0, 250] and back.tolist() == values.tolist()
    with pytest.raises(ValueError):
        token_files.unpack(b"x" * 40)


def plain(rows):
    out, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        own = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def result(docs, space):
    folder = space.path("tokens")
    files = space.stage(token_files.write(docs, folder, JSON), "files")
    got = token_files.read(docs.sparkSession, files, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]), files


def test_odd_rows(spark, odd, space, monkeypatch):
    got, _ = result(odd, space)
    assert got == plain(odd_rows())


def test_special_tokens_in_texts(spark, space):
    """Their strings give their ids, as in the plain call of the library."""
    library = Tokenizer.from_file(JSON)
    texts = ["a<|endoftext|> b", "<|endoftext|>", "a <|endoftext|>  b <|endoftext|><|endoftext|>c", "<|endoftext|", "x  <|endoftext|>\n<|endoftext|> y"]
    got, _ = result(make(spark, [(i, t, "s") for i, t in enumerate(texts)]), space)
    own = [np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for t in texts]
    assert own[0].tolist() == [64, 50256, 275, 2]
    assert [(r[2], r[3]) for r in got] == [(len(o), zlib.crc32(o.tobytes())) for o in own]


def test_empty_table(spark, empty, space):
    assert result(empty, space)[0] == []


def test_many_files(spark, space):
    """Several partitions, each with several files; starts run through all of them."""
    rows = [(i, prose(i, i % 300), "s") for i in range(400)]
    docs = make(spark, rows).repartition(4)
    small = token_files.FILE_IDS
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, files = result(docs, space)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert small == token_files.FILE_IDS
    assert got == plain(rows)
    assert files.count() > 1


def test_a_second_attempt_leaves_the_same_files(spark, odd, space):
    folder = space.path("tokens")
    first, second = (sorted(map(tuple, token_files.write(odd, folder, JSON).collect())) for _ in range(2))
    assert first == second
    files, place = token_files._open(folder)
    names = [f.base_name for f in files.get_file_info(pa.fs.FileSelector(place))]
    assert sorted(names) == sorted(r[2].rpartition("/")[2] for r in first)
