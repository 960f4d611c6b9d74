"""Fingerprints, edits and likeness against a plain version."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from conftest_llm import make, odd_rows, prose
from pyspark.sql import functions as F

from memspark.llm import fingerprints


def xx(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    units = list(" ".join(words)) if len(words) < 6 else words
    h = [xx(u) for u in units]
    digest = lambda v: (v >> 33) & 0x7FFFFFFF | 0x80000000
    if not h:
        return []
    if len(h) < 6:
        return [digest(xx(" ".join(map(str, h))))]
    g = [xx(a, b) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(g) - 4):
        inner = g[i : i + 5]
        if min(inner) in (inner[0], inner[4]):
            out.append(digest(xx(inner[0], inner[2], inner[4])))
    return out


def like(a, b):
    """The k-th of a kind with the k-th; a match whose follower in one text stands elsewhere in the other breaks the order."""
    def number(v):
        seen = Counter()
        return [(x, seen.update([x]) or seen[x]) for x in v]

    a, b = number(a), number(b)
    if not a and not b:
        return 1.0
    in_a, in_b = set(a), set(b)
    here, there = [x for x in a if x in in_b], [x for x in b if x in in_a]
    steps = set(zip(there, there[1:]))
    breaks = sum(pair not in steps for pair in zip(here, here[1:]))
    return (len(here) - breaks) / (len(a) + len(b) - len(here))


def plain(rows):
    rows = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = plain_anchors(text), plain_anchors(edited), plain_anchors(following)
        hexes = ["".join(f"{x:08x}" for x in v) for v in (a, b)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexes, like(a, b), like(a, c)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def result(docs):
    got = fingerprints.fingerprint(docs)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_odd_rows(spark, odd):
    assert result(odd) == plain(odd_rows())


@pytest.mark.parametrize("cells, rows_in_part", [(1, 10**6), (3, 7), (50, 1), (128, 2000)])
def test_ranges(spark, monkeypatch, cells, rows_in_part):
    """Any number of ranges gives the same neighbours; ids lie far apart and close together."""
    monkeypatch.setattr(fingerprints, "CELLS", cells)
    monkeypatch.setattr(fingerprints, "ROWS", rows_in_part)
    ids = [*range(40), *range(-(10**12), -(10**12) + 30), 2**60, 2**61, 2**62, 2**62 + 1]
    rows = [(d, prose(k, 1 + k % 50), "s") for k, d in enumerate(ids)]
    assert result(make(spark, rows).repartition(5)) == plain(rows)


def test_one_row_and_none(spark, empty):
    one = [(7, prose(1, 30), "s")]
    assert result(make(spark, one)) == plain(one)
    assert result(make(spark, [(None, None, None)])) == plain([(None, None, None)])
    assert result(empty) == []


def test_equal_and_edited_texts(spark):
    base = prose(5, 300)
    words = base.split()
    texts = [base, base, " ".join(words[:150] + ["changed"] + words[151:]), " ".join(words[20:]), prose(6, 300)]
    docs = make(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = [r["a"] for r in docs.orderBy("doc_id").select(fingerprints.anchors(F.col("text")).alias("a")).collect()]
    assert found[0] == found[1]
    assert like(found[0], found[2]) > 0.9 and like(found[0], found[3]) > 0.85 and like(found[0], found[4]) < 0.02


def test_matches(spark):
    base = prose(5, 100)
    docs = make(spark, [(1, base, "s")]).withColumn("other", F.concat(F.lit(prose(9, 10) + " "), "text"))
    a, b = (fingerprints.numbered(fingerprints.anchors(F.col(c))) for c in ("text", "other"))
    [row] = docs.select(fingerprints.matches(a, b).alias("m"), F.size(a).alias("n")).collect()
    assert len(row["m"]) == row["n"]
    assert len({m["other_place"] - m["place"] for m in row["m"]}) == 1


def test_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fingerprints.fingerprint(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_places_and_repeats_count(spark):
    """Moved blocks, shuffled words and the number of repeats are seen; sets of anchors would not tell them apart."""
    blocks = [prose(20 + k, 40) for k in range(6)]
    base = " ".join(blocks)
    words = base.split()
    texts = {
        "same": base,
        "swapped": " ".join([*blocks[3:], *blocks[:3]]),
        "reversed": " ".join(blocks[::-1]),
        "twice": f"{base} {base}",
        "shuffled": " ".join(" ".join(words[i : i + 8]) for i in range(len(words) - 8, -1, -8)),
    }
    docs = make(spark, [(k, t, n) for k, (n, t) in enumerate(texts.items())])
    own = fingerprints.numbered(fingerprints.anchors(F.lit(base)))
    other = fingerprints.numbered(fingerprints.anchors(F.col("text")))
    near = {r["source"]: r["n"] for r in docs.select("source", fingerprints.likeness(own, other).alias("n")).collect()}
    assert near["same"] == 1.0
    assert 0.9 < near["swapped"] < 1.0 and near["reversed"] < near["swapped"]
    assert 0.45 < near["twice"] < 0.55 and near["shuffled"] < 0.5
    for name, text in texts.items():
        assert near[name] == like(plain_anchors(base), plain_anchors(text))
