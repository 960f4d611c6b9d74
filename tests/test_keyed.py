"""Keyed state with a tag map, and folding of change batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.operators import merge
from memspark.streaming.dedupe import latest, write_changes
from memspark.streaming.keyed import change_folders, fold_changes, keyed_fold, last_changes

SCHEMA = "type string, source string, content string, tags array<string>, confidence double, ts timestamp, seq long"


def rows(numbers, tags=lambda n: [f"t{n % 3}", None][: 1 + n % 2]):
    return [("n", "s", str(n % 5), [t for t in tags(n) if t], (n % 7) / 10, datetime(2024, 1, 1) + timedelta(minutes=n), n) for n in numbers]


def run(spark, tmp_path, part):
    source, changes = str(tmp_path / "in"), str(tmp_path / "changes")
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = write_changes(keyed_fold(merge.with_identity(stream)), changes, str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    return changes


def same(one, other):
    columns = sorted(one.columns)
    left, right = (sorted(map(str, df.select(columns).collect())) for df in (one, other))
    assert left == right


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equals_the_batch_also_after_restart(spark, tmp_path, few_partitions):
    run(spark, tmp_path, rows(range(25, 40)))  # the later writes come first
    changes = run(spark, tmp_path, rows(range(25)))
    batch = merge.fold(merge.with_identity(spark.createDataFrame(rows(range(40)), SCHEMA)), hashed=True)
    same(last_changes(spark, changes), batch)
    same(latest(spark, changes), batch)
    # one more tag for one record: one change; the same write again: none
    extra = [("n", "s", "1", ["new"], 0.0, datetime(2024, 1, 1, 0, 30), 30)]
    run(spark, tmp_path, extra)
    run(spark, tmp_path, extra)
    numbers, _ = change_folders(spark, changes)
    sizes = [spark.read.parquet(f"{changes}/batch={n}").count() for n in numbers]
    assert sizes[-2:] == [1, 0]
    assert "new" in last_changes(spark, changes).filter(F.array_contains("tags", "new")).first()["tags"]


def test_folding_bounds_the_folders(spark, tmp_path):
    changes = str(tmp_path / "c")
    for n in range(7):
        data = [(bytes([h]), f"v{n}", n) for h in range(n, n + 3)]
        spark.createDataFrame(data, "content_hash binary, content string, n int").write.parquet(f"{changes}/batch={n}")
    want = sorted(map(str, last_changes(spark, changes).collect()))
    assert fold_changes(spark, changes, keep=2) == 5
    assert change_folders(spark, changes) == ([5, 6], [4])
    assert sorted(map(str, last_changes(spark, changes).collect())) == want
    assert fold_changes(spark, changes, keep=2) == 0 and fold_changes(spark, changes, keep=0) == 2
    assert change_folders(spark, changes) == ([], [6])
    assert sorted(map(str, last_changes(spark, changes).collect())) == want
    with pytest.raises(FileNotFoundError):
        last_changes(spark, str(tmp_path / "none"))


def test_many_tags_are_not_asked_for_one_by_one(spark):
    from pyspark.sql import Row
    from pyspark.sql import types as T

    from memspark.streaming.keyed import FEW_TAGS, KeyedMerge

    class State:
        def __init__(self):
            self.row, self.held, self.asked, self.written = None, set(), 0, 0

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

        def containsKey(self, tag):
            self.asked += 1
            return tag in self.held

        def updateValue(self, tag, value):
            self.held.add(tag)
            self.written += 1

        def keys(self):
            return iter(self.held)

    schema = T._parse_datatype_string("content_hash binary, id string, type string, content string, source string, tags array<string>, confidence double, created_at long, updated_at long, first_seq long")
    merged = KeyedMerge(schema)
    merged.value, merged.tags = State(), State()

    def send(first, last):
        rows = [Row(content_hash=b"h", id="i", type="n", content="c", source="s", tags=[f"t{n:03d}"], confidence=0.5, created_at=1, updated_at=1, first_seq=1) for n in range(first, last)]
        merged.tags.asked = merged.tags.written = 0
        out = list(merged.handleInputRows((b"h",), iter(rows), None))
        return out[0]["tags"] if out else None, merged.tags.asked, merged.tags.written

    many = 3 * FEW_TAGS
    names = [f"t{n:03d}" for n in range(2 * many)]
    assert send(0, many) == (names[:many], 0, many)
    assert send(1, many + 5) == (names[: many + 5], 0, 5)
    assert send(1, many) == (None, 0, 0)
    assert send(many + 5, many + 6) == (names[: many + 6], 1, 1)
    assert send(0, 1) == (None, 1, 0)
