"""Substring removal against a plain version that looks at every window."""

import random
import re

import pytest
from conftest_llm import make, odd_rows, prose

from memspark.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, words):
    """(doc_id, n_words, n_removed, kept) of every row."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    cut = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in cut:
        for p in range(len(w) - words + 1):
            g = tuple(w[p : p + words])
            least[g] = min(key(i), least.get(g, float("inf")))
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - words + 1):
            if least[tuple(w[p : p + words])] < key(i):
                gone.update(range(p, p + words))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def check(spark, rows, space, words=13, first=7, parts=4):
    docs = make(spark, rows).repartition(parts)
    got = [tuple(r) for r in sd.remove_repeats(docs, space, words, first).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, words), key=repr)
    assert spark.catalog.listTables() == [] or not any(t.name.startswith("memspark_") for t in spark.catalog.listTables())
    return got


def test_lengths():
    assert sd.lengths(13, 7) == [7, 13] and sd.lengths(13, 4) == [4, 8, 13] and sd.lengths(5, 7) == [5]
    assert sd.lengths(13, 1) == [1, 2, 4, 8, 13]


def passages(seed, n=80):
    """Documents that share passages of 1 to 60 words, some twice in one document, some with single words changed."""
    r = random.Random(seed)
    shared = [prose(1000 * seed + k, r.choice([5, 12, 13, 14, 25, 26, 27, 60])) for k in range(8)]
    rows = []
    for i in range(n):
        parts = [prose(5000 * seed + i, r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            passage = r.choice(shared).split(" ")
            if r.random() < 0.3:
                passage[r.randrange(len(passage))] = "changed"
            parts += [r.choice([" ", "\n", "\t \r\n"]).join(passage), prose(r.random(), r.randint(0, 9))]
        rows.append((r.choice([i, i, i, i // 3, None]), " ".join(parts) + r.choice(["", " ", "\n"]), "s"))
    return rows


@pytest.mark.parametrize("seed, words, first", [(1, 13, 7), (2, 13, 4), (3, 13, 1), (4, 3, 7), (5, 26, 7)])
def test_plain_version(spark, space, monkeypatch, seed, words, first):
    got = check(spark, passages(seed) + odd_rows(), space, words, first)
    assert sum(r[2] for r in got) > 0


def test_many_blocks_and_ranges(spark, space, monkeypatch):
    """Blocks of a few texts and many ranges give the same as one block."""
    blocked = [(i, t, s) for i, t, s in passages(6, 60)]
    monkeypatch.setattr(sd, "RANGE", 50)
    check(spark, blocked, space, parts=8)


def test_copies(spark, space):
    """Copies of one text: the smallest id keeps all, whatever their number, order and blocks."""
    text = prose(9, 40)
    rows = [(i, text, "s") for i in range(50, 0, -1)] + [(None, text, "s"), (1, text, "s"), (99, "a b " * 30, "s"), (98, "a b " * 30, "s")]
    got = {(r[0], r[2]) for r in check(spark, rows, space)}
    assert (1, 0) in got and (2, 40) in got and (None, 40) in got and (98, 0) in got and (99, 30) in got


def test_nothing_to_do(spark, empty, space):
    assert sd.remove_repeats(empty, space).collect() == []
    few = [(1, "a b c", "s"), (2, "a b c", "s"), (3, None, "s"), (4, "", "s")]
    assert {r[2] for r in check(spark, few, space)} == {0}


def test_no_text_moves(spark, space):
    """The bucketed blocks meet their answers without a shuffle of texts; only small columns are exchanged."""
    import io
    from contextlib import redirect_stdout

    docs = make(spark, passages(7, 40))
    sd._blocks(docs).write.option("path", space.path("b")).bucketBy(4, "block").saveAsTable("plan_of_blocks")
    try:
        rows = spark.table("plan_of_blocks").groupBy("block")
        answers = spark.createDataFrame([], sd.ANSWER)
        out = io.StringIO()
        with redirect_stdout(out):
            sd._sent(rows, answers, [7, 13], 1, 3).explain()
        exchanges = [line for line in out.getvalue().splitlines() if "Exchange" in line]
        assert len(exchanges) == 1
    finally:
        spark.sql("DROP TABLE plan_of_blocks")
