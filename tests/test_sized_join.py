"""Answers that are much longer than what is read for them."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import browse, skew


@pytest.fixture
def memories(spark):
    rows = [(f"{i:08d}-0000-4000-8000-000000000000", i) for i in range(6)]
    rows.append(rows[0])  # an id that two records have
    frame = spark.createDataFrame(rows, "id string, n int")
    tags = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.concat(F.lit("user:"), x.cast("string")))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    return frame.select(
        "id", F.lit("t").alias("type"), F.lit('"c"').alias("content"), F.lit("s").alias("source"),
        F.when(F.col("n") > 0, tags).alias("tags"), F.lit(0.5).alias("confidence"), at.alias("created_at"), at.alias("updated_at"),
    )


def asked(spark, column, prefix=""):
    ids = [f"{i % 7:08d}-0000-4000-8000-000000000000" for i in range(700)]  # the last of seven is nobody's
    return spark.createDataFrame([(i, prefix + x) for i, x in enumerate(ids)], f"request_id int, {column} string")


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("way", ["ids", "addresses"])
def test_tasks_go_by_the_bytes_of_the_answers(spark, memories, monkeypatch, way, text):
    monkeypatch.setattr(skew, "PART_BYTES", 20_000)
    memories = memories.withColumn("tags", F.array_join("tags", ",")) if text else memories
    if way == "ids":
        found = browse.get_by_ids(memories, asked(spark, "id"))
    else:
        found = browse.items_by_address(memories, asked(spark, "uri", "mem://item/"))
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["request_id"] for r in rows) == sorted([*range(700), *range(0, 700, 7)])
    assert all(r["id"] == (f"{r['request_id'] % 7:08d}-0000-4000-8000-000000000000" if r["request_id"] % 7 < 6 else None) for r in rows)
    size = {}
    for r in rows:
        size[r["task"]] = size.get(r["task"], 0) + len((r["tags"] or "") if text else ",".join(r["tags"] or []))
    assert sum(size.values()) > 1_000_000 and max(size.values()) < 8 * 20_000


def test_no_request_and_no_record(spark, memories):
    assert browse.get_by_ids(memories, asked(spark, "id").limit(0)).count() == 0
    rows = browse.get_by_ids(memories.limit(0), asked(spark, "id")).collect()
    assert len(rows) == 700 and all(r["id"] is None and r["error"].startswith("Memory not found") for r in rows)
