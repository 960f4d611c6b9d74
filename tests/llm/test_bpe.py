"""Ids against the tiktoken library, the transducer against the definition of the merges, exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import bpe
from memspark.llm.chunks import cut

RANKS = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
CODEC = bpe.codec(RANKS, P.PATTERN)
PARTS = ["a", " ", "  ", "\n", "\t", "\x85", "\xa0", "é", "'s", "'", "1", "23", "漢", "🙂", "the", " of", "\x1c", "\r\n", "_", "...", "aaaa", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(PARTS)).map("".join)))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert "".join(CODEC.decode(ids)) == text
    assert "".join(cut(text)) == text


def test_every_character():
    for start in [*range(0, 0x20000, 0x400), *range(0x20000, 0x110000, 0x8000)]:
        text = "".join(f"a{c}b {c}{c} 1{c}2 {c}" for c in map(chr, range(start, start + 0x400)) if not 0xD800 <= ord(c) < 0xE000)
        assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_classes_of_every_code_point():
    """Letters, numbers and white space are those of the library, for each code point."""
    ranks = {bytes([b]): b for b in range(256)}
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for name, kind in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", None)):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=ranks, special_tokens={})
        theirs = {c for at in range(0, len(points), 1 << 16) for c in probe.decode(probe.encode_ordinary("".join(points[at : at + (1 << 16)])))}
        assert set(bpe.compiled(name).findall("".join(points))) == theirs
        if kind:
            assert {chr(c) for c in np.flatnonzero(bpe.members(kind))} == theirs
            assert {c for c in points if c.isalpha()} <= theirs or kind == "N"


def test_doubtful_characters_beside_neighbours_that_merge():
    """Code points that other tables class otherwise, before and after characters with whose bytes theirs merge."""
    import regex

    odd = [c for k in "LN" for c in regex.findall(rf"\p{{{k}}}", "".join(map(chr, range(0xE000, 0x110000)))) if not bpe.members(k)[ord(c)]]
    odd += [chr(int(part.partition("-")[0], 16)) for text in bpe.ADDED.values() for part in text.split()]
    assert len(odd) > 10_000
    for c in odd[::7] + ["\U00019036"]:
        text = f"{c}澾 a{c}{c}1 é{c} {c}é\U0001f642{c}"
        assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_output_after_bounded_lookahead(monkeypatch):
    """What is held of a piece stays short, also where a place is always open."""
    r = random.Random(3)
    held = []
    final = bpe.Transducer._final

    def watched(self, state, last):
        out = final(self, state, last)
        held.append(len(last) - out)
        return out

    monkeypatch.setattr(bpe.Transducer, "_final", watched)
    for piece in (b"a" * 60_000, b" " * 30_000, "".join(r.choice("abcdefgh") for _ in range(60_000)).encode(), "é".encode() * 20_000, b"=-" * 20_000):
        machine = bpe.Transducer(bpe.read_ranks(RANKS))
        text = piece.decode()
        assert machine.encode(piece) == tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=machine.ranks, special_tokens={}).encode_ordinary(text)
    assert held and max(held) < 400


def test_long_pieces():
    r = random.Random(1)
    for text in ["ab" * 20_000, "".join(r.choice("abcdefgh") for _ in range(60_000)), " " * 5000 + "x", "é" * 9000]:
        ids = CODEC.encode(text)
        assert ids.tolist() == LIBRARY.encode_ordinary(text)
        assert "".join(CODEC.decode(ids)) == text


def test_transducer_starts_afresh():
    """With room for few steps the results are the same."""
    machine = bpe.Transducer(bpe.read_ranks(RANKS), steps=20)
    for word in prose(4, 300).split() + ["".join(prose(5, 400).split())]:
        assert machine.encode(word.encode()) == [machine.ranks[p] for p in machine.merged(word.encode())]
        assert machine.made <= 20


def test_small_vocabularies():
    """Random merges, in which neighbours compete more than in a trained vocabulary."""
    r = random.Random(7)
    for _ in range(60):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 25:
            new = r.choice(tokens) + r.choice(tokens)
            if new not in tokens and len(new) < 9:
                tokens.append(new)
        machine = bpe.Transducer({t: i for i, t in enumerate(tokens)})
        for _ in range(60):
            data = bytes(r.choice(b"abc") for _ in range(r.randint(1, 25)))
            whole = machine.ranks.get(data)
            assert machine.encode(data) == ([whole] if whole is not None else [machine.ranks[p] for p in machine.merged(data)])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=40), st.text(max_size=20).map(str.encode)), st.lists(st.integers(1, 5), max_size=40))
def test_streaming_utf8(data, steps):
    """Bytes in any portions read as the same text; no part ends inside a character."""
    machine, out, at = bpe.Utf8(), "", 0
    for step in steps:
        out += machine.feed(data[at : at + step])
        at += step
        assert len(machine.held) < 4
    out += machine.feed(data[at:]) + machine.end()
    assert out == data.decode("utf-8", "replace")


def test_odd_rows(spark, odd):
    got = odd.select("doc_id", "text", bpe.coded(F.col("text"), RANKS, P.PATTERN).alias("d")).select("doc_id", "text", "d.*").collect()
    assert len(got) == len(odd_rows())
    for r in got:
        text = r["text"] or ""
        ids = LIBRARY.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_columns(spark, odd, empty):
    back = odd.select("text", bpe.decode(bpe.encode(F.col("text"), RANKS, P.PATTERN), RANKS, P.PATTERN).alias("b"))
    assert all(r["b"] == (r["text"] or "") for r in back.collect())
    assert empty.select(bpe.digest(F.col("text"), RANKS, P.PATTERN)).count() == 0


@pytest.mark.parametrize("text", ["", "a", " a", "a ", " ", "  a", "a  b", "a\n b", "\n"])
def test_cuts(text):
    joined = [i for part in cut(text) for i in LIBRARY.encode_ordinary(part)]
    assert joined == LIBRARY.encode_ordinary(text)


def test_coded_rows_leave_in_parts(spark, monkeypatch):
    texts = ["Hello, world", None, "", "naïve   text\n\n", "x" * 300] * 4
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").coalesce(1)
    want = {r["doc_id"]: tuple(r["d"]) for r in rows.select("doc_id", bpe.coded(F.col("text"), RANKS, P.PATTERN).alias("d")).collect()}
    monkeypatch.setattr(bpe, "CODED_SLICE", 200)
    found = bpe.coded_rows(rows, "text", RANKS, P.PATTERN)
    assert found.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r["doc_id"]: tuple(r)[2:] for r in found.collect()} == want
