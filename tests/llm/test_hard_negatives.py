"""Hard negatives against a search through all pairs, and the tree against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import hard_negatives as hn

ROWS = "vec_id long, label int, q array<int>, leaf long, block long, tag long, score long, anchor long"


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], ROWS)


def plain(rows, every):
    held = {}
    for i, label, q in rows:
        if i is None or label is None or q is None or any(x is None or abs(x) >= hn.BOUND for x in q):
            continue
        held.setdefault(len(q), []).append((i, label, tuple(q)))
    if not held:
        return []
    own = {}
    for i, label, q in max(sorted(held.items()), key=lambda kv: len(kv[1]))[1]:
        own[i] = min(own.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in own.items():
        if a % every:
            continue
        scored = sorted((-dot(q, other), i, kind) for i, (kind, other) in own.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][: hn.POSITIVES]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, n + 1, i, -s, -v) for n, (v, i, _) in enumerate(fits[: hn.NEGATIVES])]
    return out


def check(spark, rows, space, every=5, parts=3):
    found = hn.mine(make(spark, rows).repartition(parts), F.col("vec_id") % every == 0, space)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(plain(rows, every))
    return got


def clustered(seed, n, dim, scale=100):
    r = np.random.default_rng(seed)
    centres = r.normal(0, scale, (6, dim))
    which = r.integers(0, 6, n)
    vectors = np.floor(centres[which] + r.normal(0, scale / 4, (n, dim))).astype(int)
    return [(int(i), int(r.integers(0, 3)), v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("seed, dim, scale", [(1, 3, 100), (2, 16, 30), (3, 2, 3)])
def test_all_pairs(spark, space, monkeypatch, seed, dim, scale):
    """Small leaves, blocks and chunks, so that many of each meet."""
    for name, value in {"BLOCK": 12, "CHUNK": 7}.items():
        monkeypatch.setattr(hn, name, value)
    whole = hn.build
    monkeypatch.setattr(hn, "build", lambda rows, space: whole(rows, space, sample=120, leaf=20))
    assert check(spark, clustered(seed, 300, dim, scale), space)


def test_odd_rows(spark, space):
    rows = clustered(4, 60, 4)
    rows += [(None, 1, [1, 2, 3, 4]), (100, None, [1, 2, 3, 4]), (105, 1, None), (110, 1, [1, None, 3, 4]), (115, 1, []), (120, 1, [1, 2])]
    rows += [(5, 2, [9, 9, 9, 9]), (5, 0, [9, 9, 9, 9]), rows[10], rows[10], (125, 1, [hn.BOUND, 0, 0, 0]), (130, 1, [0, 0, 0, 0])]
    rows += [(135, 1, [hn.BOUND - 1] * 4), (140, 2, [hn.BOUND - 1] * 4), (145, 1, [1 - hn.BOUND] * 4)]
    check(spark, rows, space)


def test_equal_vectors(spark, space, monkeypatch):
    """A third of all rows share one vector: they make many blocks of one leaf, and ties go by vec_id."""
    monkeypatch.setattr(hn, "BLOCK", 10)
    rows = clustered(5, 120, 4)
    rows = [(i, label, [50, 60, 70, 80] if i % 3 == 0 else q) for i, label, q in rows]
    assert check(spark, rows, space)


def test_nothing(spark, space):
    assert check(spark, [], space) == []
    assert check(spark, [(0, 1, None)], space) == []
    assert check(spark, [(0, 1, [1, 2]), (5, 2, [1, 2])], space) == []
    assert check(spark, [(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 3])], space) == [(0, 1, 1, 2, 25, 18)]


def test_tree_finds_every_leaf():
    """Every member of a window lies in a leaf that the query reaches, and leaves out of reach are left out."""
    r = np.random.default_rng(6)
    rows = np.floor(np.array([v for *_, v in clustered(7, 3000, 5)], float))
    tree = hn.Tree(np.unique(rows[::3], axis=0), 20)
    best = {}
    for part in np.array_split(rows, 4):
        for *key, low, high in tree.ranges(part):
            a, b = best.get(tuple(key), (low, high))
            best[tuple(key)] = (min(a, low), max(b, high))
    tree.with_ranges([(*k, *v) for k, v in best.items()])
    leaf = tree.place(rows)
    queries = rows[r.choice(len(rows), 60, replace=False)]
    scores = queries @ rows.T
    top = np.sort(scores, axis=1)[:, -20]
    who = np.concatenate([np.arange(60), np.arange(60)])
    lo, hi = np.concatenate([top, 0.3 * top]), np.concatenate([np.full(60, 1e18), 0.4 * top])
    found = set(zip(*[x.tolist() for x in tree.reach(queries, who, lo, hi)]))
    for w in range(120):
        members = (scores[who[w]] >= lo[w]) & (scores[who[w]] <= hi[w])
        assert {(int(who[w]), int(x)) for x in np.unique(leaf[members])} <= found
    near = set(zip(*[x.tolist() for x in tree.reach(queries, who[:60], lo[:60], hi[:60])]))
    assert len(near) < 0.5 * 60 * tree.leaves


def test_quantised(spark):
    kinds = [[0.5, -0.001], [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], [1e30, 0.0], None, []]
    rows = spark.createDataFrame([(k,) for k in kinds], "v array<float>")
    assert [r[0] for r in rows.select(hn.quantised(F.col("v"))).collect()] == [[128, -1], None, None, None, None, None, []]
