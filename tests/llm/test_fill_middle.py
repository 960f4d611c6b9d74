"""Fill-in-the-middle against a plain version, and the marks against byte loops."""

import hashlib
import re

import numpy as np
import pytest
from conftest_llm import make, odd_rows, prose
from pyspark.sql import functions as F

from memspark.llm import fill_middle as fim
from memspark.llm.words import utf8

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "", " ", "a", " a", "a ", "  a  ", "a b", "\ta\r\nb\x0b\x0c c \n", "é 漢字 x 🙂🙂   y", "x\x00 \x1c \x85 z",
    "<P> a b", "a <S", "a <S> b", "ends with <M>", "<P", "a<<b> >c <S P> S> <", "<p> <m> small", " " * 30, "ab" * 5_000,
    "🙂" * 700 + " " + "é" * 801, "a  b   c    d     e      f       g        h         i ",
]


def test_every_length_and_place():
    """All strings of up to four signs, in one batch, so that every shift against the 64-bit words occurs."""
    signs = [" ", "\t", "\r", "a", "é", "🙂", "\x08", "\x0e", "!"]
    texts = [""]
    for _ in range(4):
        texts += [t + c for t in texts[-len(signs) ** 4 :] for c in signs][: 9**4]
    import pyarrow as pa

    data, offsets = utf8(pa.array(texts))
    units = fim.Units(data, offsets)
    found = [UNIT.findall(t) for t in texts]
    assert units.count.tolist() == [len(f) for f in found]
    for k in range(5):
        at = units.after(np.minimum(k, units.count))
        want = [len("".join(f[:k]).encode()) for f in found]
        assert (at - offsets[:-1]).tolist() == want
        assert units.chars(offsets[:-1], at).tolist() == [len("".join(f[:k])) for f in found]


@pytest.mark.parametrize("seed", range(3))
def test_plain_version(spark, seed):
    rows = odd_rows() + [(1000 * seed + i, t, "s") for i, t in enumerate(TEXTS * 8)]
    rows += [(5000 + i, prose(i, 3 * i) + " " * (i % 3), "s") for i in range(60)] + [(9000, None, "s"), (None, "a b c d", "s")]
    docs = make(spark, rows).repartition(4)
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    found = [tuple(r) for r in made.collect()]
    want = [(i, *plain(i, t), t or "") for i, t, _ in rows]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}


def test_slices(spark, monkeypatch):
    """A batch worked on in many slices gives the same."""
    import pyarrow as pa

    texts = pa.array(TEXTS + [None])
    draws = [np.arange(len(texts)) * k for k in (7, 3, 0, 50)]
    whole = fim._arranged(texts, draws, 100, 80).to_pylist()
    single = [fim._arranged(texts.slice(i, 1), [d[i : i + 1] for d in draws], 100, 80).to_pylist()[0] for i in range(len(texts))]
    assert whole == single


def test_empty(spark, empty):
    made = fim.fill_in_middle(empty)
    assert made.collect() == [] and made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
