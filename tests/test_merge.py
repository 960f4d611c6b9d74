from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from memspark.operators import merge

START = datetime(2024, 1, 1)
SCHEMA = "type string, source string, content string, tags array<string>, confidence double, ts timestamp, seq long"


def writes(count, seed=0):
    random = Random(seed)
    rows = []
    for seq in range(count):
        # A third of all writes share one content.
        content = "0" if random.random() < 0.34 else str(random.randrange(1, 15))
        tags = random.sample([f"t{i}" for i in range(12)], random.randrange(0, 5))
        # Equal hashes from different type and source, to see which writer is kept.
        type_, source = random.choice([("a::b", "c"), ("a", "b::c")])
        rows.append((type_, source, content, tags, random.random(), START + timedelta(seconds=random.randrange(50)), seq))
    return rows


def expected(rows):
    out = {}
    for type_, source, content, tags, confidence, ts, seq in sorted(rows, key=lambda r: (r[5], r[6])):
        key = f"{type_}::{source}::{content}"
        kept = out.setdefault(key, [type_, source, content, set(), 0.0, ts, ts, seq])
        kept[3] |= set(tags)
        kept[4], kept[6] = max(kept[4], confidence), max(kept[6], ts)
    return sorted((t, s, c, sorted(g), f, a, b, q) for t, s, c, g, f, a, b, q in out.values())


def state(spark, rows):
    return merge.with_identity(spark.createDataFrame(rows, SCHEMA))


def collected(df):
    return sorted(
        (r.type, r.source, r.content, r.tags, r.confidence, r.created_at, r.updated_at, r.first_seq) for r in df.collect()
    )


@pytest.mark.parametrize("hashed", [True, False])
def test_fold(spark, hashed):
    rows = writes(300)
    assert collected(merge.fold(state(spark, rows), hashed)) == expected(rows)


def test_order_and_split_do_not_matter(spark):
    rows = writes(200, seed=1)
    want = expected(rows)
    for seed in range(3):
        shuffled = Random(seed).sample(rows, len(rows))
        cut = len(rows) // (seed + 2)
        table = merge.fold(state(spark, shuffled[:cut]))
        table = merge.upsert(table, merge.fold(state(spark, shuffled[cut:])))
        assert collected(table) == want


def test_replay_changes_nothing_and_resend_touches_only_the_time(spark):
    rows = writes(60, seed=2)
    table = merge.fold(state(spark, rows))
    assert collected(merge.upsert(table, state(spark, rows))) == expected(rows)
    later = [(*r[:5], START + timedelta(days=1), r[6] + 1000) for r in rows]
    again = merge.upsert(table, state(spark, later))
    assert [r[:6] + r[7:] for r in collected(again)] == [r[:6] + r[7:] for r in expected(rows)]
    assert {r[6] for r in collected(again)} == {START + timedelta(days=1)}


def test_rows_without_hash_stay(spark):
    rows = writes(20, seed=3)
    base = merge.fold(state(spark, rows))
    both = merge.append(base, state(spark, rows))
    folded = merge.fold(both)
    assert folded.count() == base.count() + 20
    assert folded.filter("content_hash is null").count() == 20
    assert merge.duplicate_hashes(folded).count() == 0
    assert merge.duplicate_hashes(state(spark, rows)).count() > 0


def test_touched(spark):
    rows = writes(50, seed=4)
    merged = merge.fold(state(spark, rows))
    batch = state(spark, [r for r in rows if r[2] == "0"])
    out = merge.touched(merged, batch)
    assert [r.content for r in out.collect()] == ["0"]
    assert "embedding" not in out.columns and "content_hash" not in out.columns


def test_empty_tags_and_defaults(spark):
    rows = [("t", "s", "{}", None, 0.5, START, 1), ("t", "s", "{}", [], 0.1, START, 2)]
    row = merge.fold(state(spark, rows)).first()
    assert row.tags == [] and row.confidence == 0.5
    assert state(spark, rows).filter(F.size("tags") == 0).count() == 2
