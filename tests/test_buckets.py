"""Buckets of the table, summaries of hashes, and lists of the newest records kept beside it."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.operators import browse, known, merge
from memspark.operators.newest import KEPT, browse_table
from memspark.sources.scratch import Workspace
from memspark.sources.table import MemoryTable

START = datetime(2024, 1, 1)
SCHEMA = "type string, source string, content string, tags array<string>, confidence double, ts timestamp, seq long"


def plan(df):
    return df._jdf.queryExecution().toString()


def batch(spark, rows):
    """rows: (content, tags, minute, seq); equal contents are one record."""
    full = [("note" if int(c) % 3 else "log", "s", c, tags, (q % 10) / 10, START + timedelta(minutes=m), q) for c, tags, m, q in rows]
    writes = merge.with_identity(spark.createDataFrame(full, SCHEMA))
    return merge.fold(writes.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), hashed=True)


def rows_of(memories, **how):
    names = ["id", "type", "content", "tags", "confidence", "created_at", "updated_at", "first_seq", "embedding"]
    return sorted(map(str, memories.read(**how).select(*names).collect()))


def new_table(spark, tmp_path, name, buckets=64):
    return MemoryTable.create(spark, str(tmp_path / name), 1, "none", buckets)


def numbered(a, b, minute=0):
    return [(str(i), [f"t{i % 4}"], minute, i) for i in range(a, b)]


def only(spark, frame, buckets, wanted):
    return frame.filter(known.bucket_of(F.col("content_hash"), buckets).isin(wanted))


def test_bucket_is_a_hash_prefix(spark):
    hashes = spark.range(500).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("h"))
    found = hashes.select("h", known.bucket_of(F.col("h"), 64).alias("b")).collect()
    assert all(r.b == r.h[0] >> 2 for r in found)


def test_compact_rewrites_touched_buckets_only(spark, tmp_path):
    memories, whole = new_table(spark, tmp_path, "a"), new_table(spark, tmp_path, "b", 1)
    first = batch(spark, numbered(0, 600))
    late = only(spark, batch(spark, numbered(0, 900, 5)), 64, [7])
    for table in (memories, whole):
        table.append(first)
        assert table.compact() == table.buckets
        table.append(late)
    before = memories.state().base
    size = sum(memories._bytes(p) for p in memories._parts(memories.state())[0])
    assert memories.compact() == 1 and whole.compact() == 1
    after = memories.state().base
    assert [b for b in after if after[b] != before[b]] == [7]
    rewritten = memories._bytes(f"{after[7]['folder']}/data")
    assert rewritten < size / 30
    assert rows_of(memories) == rows_of(whole)
    assert memories.pending == 0 and merge.duplicate_hashes(memories.read()).count() == 0
    # the old folder still holds 63 buckets; the one that was replaced goes
    old = before[7]["folder"]
    assert 7 in memories._written(old)
    expected = rows_of(memories)
    memories.drop_unused(older_than_hours=0)
    assert 7 not in memories._written(old) and len(memories._written(old)) == 63
    assert rows_of(memories) == expected


def test_writers_of_different_buckets_both_commit(spark, tmp_path):
    memories = new_table(spark, tmp_path, "a", 4)
    memories.append(batch(spark, numbered(0, 40)))
    memories.compact()
    memories.append(batch(spark, numbered(20, 60, 3)))
    expected = rows_of(memories)
    write, other = memories._write, MemoryTable(spark, memories.root)

    def write_while_another_folds(records, folder):
        memories._write = write
        assert other.compact(buckets=[2, 3]) == 2
        write(records, folder)

    memories._write = write_while_another_folds
    assert memories.compact(buckets=[0, 1]) == 2
    assert memories.pending == 0 and rows_of(memories) == expected

    memories.append(batch(spark, numbered(0, 60, 4)))
    memories._write = write_while_another_folds
    with pytest.raises(RuntimeError, match="compacted by someone else"):
        memories.compact()
    assert memories.compact() == 2
    assert len(rows_of(memories)) == 60


def test_new_batch_reads_no_base(spark, tmp_path):
    memories = new_table(spark, tmp_path, "a", 16)
    memories.append(batch(spark, numbered(0, 300)))
    memories.compact()
    memories.append(batch(spark, numbered(300, 330)))
    space = Workspace(spark)
    fresh = space.stage(batch(spark, numbered(1000, 1100)), "fresh")
    state = memories.state()
    assert state.complete
    found = memories.known(fresh, space)
    assert found.stored is None
    mixed = space.stage(batch(spark, numbered(290, 400, 9)), "mixed")
    found = memories.known(mixed, space)
    assert sorted(int(r.content) for r in found.stored.select("content").collect()) == list(range(290, 330))
    assert "embedding" not in found.stored.columns


@pytest.mark.parametrize("segments", [1, 8])
def test_summaries_have_no_false_negative_and_few_false_positives(spark, segments):
    hashes = spark.range(4000).select(F.col("id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("content_hash"))
    held = hashes.filter("id < 2000")
    parts = [known.summary(held.filter(f"id % 3 = {k}"), 4, segments) for k in range(3)]
    summaries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hits = known.maybe_known(hashes, summaries, 4, [segments]).join(hashes, "content_hash").select("id").collect()
    ids = {r.id for r in hits}
    assert set(range(2000)) <= ids and len(ids) <= 2010
    both = summaries.unionByName(known.summary(hashes.filter("id >= 3990"), 4, 2))
    hits = known.maybe_known(hashes, both, 4, [segments, 2]).join(hashes, "content_hash").select("id").collect()
    assert set(range(2000)) | set(range(3990, 4000)) <= {r.id for r in hits}
    assert known.merged(summaries).count() == 4 * segments


def test_random_writes_in_any_split(spark, tmp_path):
    """Batches with folds between them, of all buckets or of some, equal one batch of everything."""
    r = random.Random(5)
    writes = [(str(r.randrange(60)), [f"t{r.randrange(5)}", f"u{r.randrange(3)}"], r.randrange(500), q) for q in range(400)]
    memories = new_table(spark, tmp_path, "a", 8)
    for k in range(5):
        memories.append(batch(spark, writes[k::5]))
        if k == 1:
            memories.compact()
        if k == 3:
            memories.compact(buckets=[1, 2, 5])
    whole = batch(spark, writes)
    names = ["id", "tags", "confidence", "created_at", "updated_at", "first_seq"]
    assert sorted(map(str, memories.read().select(*names).collect())) == sorted(map(str, whole.select(*names).collect()))
    some = rows_of(memories, buckets=[0, 5])
    assert some and set(some) < set(rows_of(memories))


def addresses(spark):
    uris = ["mem://recent", "mem://recent?limit=100", "mem://by-type/note?limit=100", "mem://by-type/none", "mem://by-tags/t1,t2?limit=100", "mem://by-tags/new?limit=50", "mem://by-tags/rare", "mem://by-type/log?limit=7"]
    return spark.createDataFrame(list(enumerate(uris)), "request_id long, uri string")


def answers(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("late", [False, True])
def test_lists_equal_the_records(spark, tmp_path, late):
    """Also after merges that move updated_at, and after late writes that move created_at back."""
    r = random.Random(8)
    memories = new_table(spark, tmp_path, "a", 2)
    rows = [(str(i), [f"t{i % 4}"] + (["rare"] if i % 100 == 0 else []), r.randrange(50) + 1000, i) for i in range(900)]
    memories.append(batch(spark, rows))
    memories.compact()
    asked = addresses(spark)

    def check():
        found = browse_table(memories, asked)
        assert answers(found) == answers(browse.browse_many(memories.read(), asked))
        return found

    found = check()
    assert "/base-" not in plan(found) or "/newest" in plan(found)
    # new tags for old records, later; new records
    again = [(str(i), ["new", "t1"], 5000, 10_000 + i) for i in range(0, 900, 30)]
    memories.append(batch(spark, again + [(str(i), ["t2"], 6000, 20_000 + i) for i in range(2000, 2040)]))
    assert memories.state().complete
    check()
    if late:
        # most of the newest records turn out to be old, so the lists no longer reach
        memories.append(batch(spark, [(str(i), ["t3"], 1, 30_000 + i) for i in range(900) if i % 4]))
        check()
    memories.compact(buckets=[1])
    check()
    memories.compact()
    check()


def test_lists_are_all_that_is_read(spark, tmp_path, monkeypatch):
    """With an unchanged base no subfolder of records is opened, and with pending batches only theirs."""
    memories = new_table(spark, tmp_path, "a", 4)
    memories.append(batch(spark, numbered(0, 200)))
    memories.compact()
    opened, scan = [], MemoryTable._scan
    monkeypatch.setattr(MemoryTable, "_scan", lambda self, paths: opened.extend(paths) or scan(self, paths))
    assert browse_table(memories, addresses(spark)).count() > 0
    assert opened == []
    memories.append(batch(spark, numbered(190, 260, 4)))
    opened.clear()
    assert browse_table(memories, addresses(spark)).count() > 0
    assert opened and all(path.startswith("delta-") for path in opened)


def test_batch_that_missed_a_fold_is_not_relied_on(spark, tmp_path):
    memories = new_table(spark, tmp_path, "a", 2)
    memories.append(batch(spark, numbered(0, 30)))
    space = Workspace(spark)
    rows = space.stage(batch(spark, numbered(0, 40, 7)), "rows")
    found = memories.known(rows, space)
    MemoryTable(spark, memories.root).compact()
    memories.append(rows, known=found)
    assert not memories.state().complete
    asked = addresses(spark)
    assert answers(browse_table(memories, asked)) == answers(browse.browse_many(memories.read(), asked))
    memories.compact()
    assert memories.state().complete and KEPT >= 100


def test_rare_tag_reads_few_buckets(spark, tmp_path, monkeypatch):
    memories = new_table(spark, tmp_path, "a")
    rows = numbered(0, 600) + [("700", ["rare"], 0, 700), ("701", ["rare", "t1"], 0, 701)]
    memories.append(batch(spark, rows))
    memories.compact()
    memories.append(batch(spark, [("5", ["rare"], 3, 900), ("6", ["t2"], 3, 901), ("1000", ["late"], 3, 902)]))
    whole = memories.read()
    opened, scan = set(), MemoryTable._scan
    monkeypatch.setattr(MemoryTable, "_scan", lambda self, paths: opened.update(paths) or scan(self, paths))
    for tags, kind, most in ((["rare"], None, 3), (["late", "none"], None, 1), (["none"], None, 0), (["t1", "rare"], "log", 64), ([], "log", 64), (["rare"], "none", 3)):
        opened.clear()
        found = sorted(r["content"] for r in memories.read_tagged(tags, kind).collect())
        want = whole.filter("true" if kind is None else f"type = '{kind}'")
        want = want.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))) if tags else want
        assert found == sorted(r["content"] for r in want.collect())
        assert len([path for path in opened if path.startswith("base-")]) <= most


def test_stored_vectors_without_reading_the_base(spark, tmp_path, monkeypatch):
    from memspark.functions.canonical import embedding_key

    memories = new_table(spark, tmp_path, "a", 16)
    memories.append(batch(spark, numbered(0, 200)))
    memories.compact()
    memories.append(batch(spark, numbered(190, 220, 2)))
    space = Workspace(spark)

    def found(a, b):
        keys = spark.range(a, b).select(embedding_key(F.col("id").cast("string"), "none").alias("embed_key"), "id")
        got = memories.stored_vectors(keys, space).join(keys, "embed_key").collect()
        assert all(list(r["embedding"]) == [1.0] for r in got)
        return sorted(r["id"] for r in got)

    assert found(150, 300) == list(range(150, 220))
    opened, scan = [], MemoryTable._scan
    monkeypatch.setattr(MemoryTable, "_scan", lambda self, paths: opened.extend(paths) or scan(self, paths))
    assert found(5000, 5100) == []
    assert not any(path.startswith("base-") for path in opened)
    opened.clear()
    assert found(17, 18) == [17]
    assert len([path for path in opened if path.startswith("base-")]) == 1


def test_lists_do_not_carry_the_tags_of_their_records(spark, tmp_path):
    """A record stands in a list for each of its tags: with all tags in every entry, lists grow with the square of their number."""
    memories = new_table(spark, tmp_path, "a", 2)
    memories.append(batch(spark, [(str(i), [f"t{i}-{k}" for k in range(50)], 0, i) for i in range(20)]))
    memories.compact()
    state = memories.state()
    kept = memories.newest(state)
    assert "tags" not in kept.columns and kept.filter("shelf LIKE 'tag:%'").count() == 20 * 50
    cards = memories.cards(state).collect()
    assert len(cards) == 20 and all(len(r["tags"]) == 50 for r in cards)
    space = Workspace(spark)
    asked = spark.createDataFrame([(0, "mem://by-tags/t3-7"), (1, "mem://recent?limit=5")], "request_id long, uri string")
    for found in (browse.browse_many(memories.read(), asked, workspace=space), browse_table(memories, asked, workspace=space)):
        assert sorted((r["request_id"], len(r["tags"])) for r in found.collect()) == [(0, 50)] + [(1, 50)] * 5
    for label in ("newest", "met"):
        assert "tags" not in spark.read.parquet(f"{space.folder}/{label}-*").columns


def test_lists_written_before_there_were_cards(spark, tmp_path):
    memories = new_table(spark, tmp_path, "a", 2)
    memories.append(batch(spark, numbered(0, 40)))
    memories.compact()
    asked = addresses(spark)
    expected = answers(browse_table(memories, asked))

    def older(pointer):
        for entry in pointer["base"].values():
            del entry["cards"]

    memories._commit(older)
    assert answers(browse_table(memories, asked)) == expected


def test_only_asked_columns_go_through_the_merge(spark, tmp_path):
    """Also with a base, buckets that no batch touches, and several batches."""
    memories = new_table(spark, tmp_path, "a", 4)
    memories.append(batch(spark, numbered(0, 60)))
    columns = ["id", "confidence", "embedding"]
    for _ in range(2):
        whole, part = memories.read(), memories.read(columns=columns)
        assert part.columns == columns
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(*columns).collect()))
        scans = [line for line in plan(part).splitlines() if "ReadSchema" in line]
        assert scans and not any("content:" in line or "lexemes" in line for line in scans)
        memories.compact()
        memories.append(only(spark, batch(spark, numbered(40, 90, 5)), 4, [2]))


def test_a_large_batch_has_a_task_for_every_piece_of_a_bucket(spark, tmp_path):
    memories = new_table(spark, tmp_path, "a", 4)
    records = batch(spark, numbered(0, 400))
    small, large = memories._dealt_batch(records, 1000), memories._dealt_batch(records, 4 * (40 << 20))
    where = F.spark_partition_id().alias("p"), known.bucket_of(F.col("content_hash"), 4).alias("b")
    held = large.select(*where).distinct().collect()
    assert len(held) == len({r.p for r in held}) == 12  # no task has two buckets, no bucket one task
    assert {r.p // 3 == r.b for r in held} == {True}
    assert sorted(r.b for r in small.select(where[1]).distinct().collect()) == [0, 1, 2, 3]
    folder = memories.append(records, size=4 * (40 << 20))
    assert memories.batch(folder).count() == 400 and len(rows_of(memories)) == 400
