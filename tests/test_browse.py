from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from memspark.operators import browse, shape
from memspark.operators.filters import matching
from memspark.sources.results import json_rows, write_json

START = datetime(2024, 1, 1)
COUNT = 400


def uid(n):
    return f"{n:08x}-0000-0000-0000-00000000000a"


@pytest.fixture(scope="module")
def rows():
    random = Random(5)
    # Every tenth moment is shared by many records, so ties are common.
    return [
        (
            uid(n),
            random.choice(["a", "b", "c+d", "x/y"]),
            '{"k":[1,{"b":"x"}],"z":{}}',
            "app",
            None if n % 50 == 0 else random.sample(["t0", "t1", "t2", "T3"], random.randrange(0, 3)),
            n / COUNT,
            START + timedelta(minutes=n // 10),
            START + timedelta(days=1),
        )
        for n in range(COUNT)
    ]


@pytest.fixture(scope="module")
def memories(spark, rows):
    schema = (
        "id string, type string, content string, source string, tags array<string>, "
        "confidence double, created_at timestamp, updated_at timestamp"
    )
    return spark.createDataFrame(rows, schema).repartition(4, "id").persist()


def newest(rows, type_=None, tags=None, limit=None):
    hits = [r for r in rows if (not type_ or r[1] == type_) and (not tags or set(tags) & set(r[4] or []))]
    ordered = sorted(hits, key=lambda r: (-r[6].timestamp(), r[0]))
    return [r[0] for r in ordered[:limit]]


def ids(df):
    return [r.id for r in df.collect()]


def test_lists(memories, rows):
    assert ids(browse.listed(memories)) == newest(rows)
    assert ids(browse.listed(memories, "a", ["t1", "T3"])) == newest(rows, "a", ["t1", "T3"])
    assert ids(browse.recent(memories)) == newest(rows, limit=20)
    assert ids(browse.recent(memories, 0)) == newest(rows, limit=1)
    assert ids(browse.recent(memories, 500)) == newest(rows, limit=100)
    assert ids(browse.recent_by_type(memories, "")) == newest(rows, limit=20)
    assert ids(browse.recent_by_type(memories, " a")) == []
    assert ids(browse.recent_by_tags(memories, " t1 ,, T3", 5)) == newest(rows, None, ["t1", "T3"], 5)
    assert ids(browse.recent_by_tags(memories, "t3")) == []
    assert ids(browse.recent_by_tags(memories, " , ", 3)) == newest(rows, limit=3)


def test_null_tags_never_overlap(spark):
    df = spark.createDataFrame([(["a", None],), ([None],), (None,), (["b"],)], "tags array<string>")
    assert matching(df, tags=["a"]).count() == 1


def test_get_by_ids(spark, memories, rows):
    asked = [(n, f" {uid(n % 3).upper()} ") for n in range(60)]
    asked += [(100, uid(5)), (101, uid(99999).upper()), (102, "nope"), (103, None), (104, " ")]
    requests = spark.createDataFrame(asked, "request_id long, id string")
    out = {r.request_id: r for r in browse.get_by_ids(memories, requests).collect()}
    assert len(out) == len(asked)
    assert all(out[n].id == uid(n % 3) and out[n].error is None for n in range(60))
    assert out[100].content == rows[5][2]
    assert out[101].error == f"Memory not found: {uid(99999).upper()}" and out[101].id is None
    assert out[102].error == "id must be a valid UUID format"
    assert out[103].error == out[104].error == "id is required and must be a non-empty string"


ADDRESSES = [
    ("mem://recent", ("recent", "", 20, None)),
    ("mem://recent?limit=5", ("recent", "", 5, None)),
    ("mem://recent?x=1&limit=7abc", ("recent", "", 7, None)),
    ("mem://recent?limit=5&limit=7", ("recent", "", 5, None)),
    ("mem://recent?limit=7&x=2&limit=5", ("recent", "", 7, None)),
    ("mem://recent?xlimit=9&limit=5", ("recent", "", 5, None)),
    ("mem://recent?limit&limit=5", ("recent", "", None, "limit must be a number")),
    ("mem://recent?limit=-4", ("recent", "", 1, None)),
    ("mem://recent?limit=99999999999999", ("recent", "", 100, None)),
    ("mem://recent?limit=abc", ("recent", "", None, "limit must be a number")),
    ("mem://by-type/c+d?limit=3", ("by-type", "c+d", 3, None)),
    ("mem://by-type/x%2Fy", ("by-type", "x/y", 20, None)),
    ("mem://by-type/", ("by-type", "", 20, None)),
    ("mem://by-tags/t1,%20T3", ("by-tags", "t1, T3", 20, None)),
    ("mem://by-tags/%zz", ("by-tags", None, 20, "URI malformed")),
    ("mem://item/abc", ("item", "abc", 20, None)),
    ("mem://nothing/x", (None, None, None, "Unknown resource: mem://nothing/x")),
    ("http://x", (None, None, None, "Unknown resource: http://x")),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ADDRESSES)], "request_id int, uri string")
    out = sorted(browse.parse_addresses(df).collect(), key=lambda r: r.request_id)
    for (uri, (view, argument, limit, error)), row in zip(ADDRESSES, out):
        assert row.error == error, uri
        if error is None:
            assert (row.view, row.argument, row.limit) == (view, argument, limit), uri


def test_browse_many(spark, memories, rows):
    asked = [a for a, _ in ADDRESSES] + ["mem://by-tags/t0,t1,t2,T3?limit=100", "mem://by-type/a?limit=100"]
    asked += ["mem://by-tags/t1?limit=2"] * 30 + ["mem://by-tags/%20,", "mem://by-tags/none"]
    df = spark.createDataFrame(list(enumerate(asked)), "request_id int, uri string")
    found = {}
    for r in browse.browse_many(memories, df).orderBy("request_id", "rank").collect():
        found.setdefault(r.request_id, []).append(r.id)
    parsed = {r.request_id: r for r in browse.parse_addresses(df).collect()}
    for n, uri in enumerate(asked):
        p = parsed[n]
        want = []
        if p.error is None and p.view != "item":
            tags = browse.split_tags(p.argument) if p.view == "by-tags" else None
            want = newest(rows, p.argument if p.view == "by-type" else None, tags, p.limit)
        assert found.get(n, []) == want, uri


def test_items_by_address(spark, memories, rows):
    asked = [f"mem://item/{uid(3)}"] * 20 + [f"mem://item/{uid(4).upper()}?limit=1", "mem://item/none", "mem://recent"]
    df = spark.createDataFrame(list(enumerate(asked)), "request_id int, uri string")
    out = {r.request_id: r for r in browse.items_by_address(memories, df).collect()}
    assert set(out) == set(range(22)) and {out[n].id for n in range(20)} == {uid(3)}
    assert out[20].source == "app" and out[21].id is None and out[21].content is None


def test_shapes(spark, memories, tmp_path):
    one = memories.filter(F.col("id") == uid(0))
    assert shape.list_items(one).first().asDict() == {
        "id": uid(0), "type": one.first().type, "tags": [], "createdAt": START,
    }
    assert shape.full_records(one).columns[-2:] == ["createdAt", "updatedAt"]
    link = shape.with_links(one).first()
    assert (link.uri, link.name) == (f"mem://item/{uid(0)}", f"memory:{uid(0)}")
    card = shape.record_cards(memories.filter(F.col("id") == uid(100))).first().text.split("\n")
    assert card[4:8] == [
        "Confidence: 0.25",
        "Created: Mon Jan 01 2024 00:10:00 GMT+0000 (Coordinated Universal Time)",
        "Updated: Tue Jan 02 2024 00:00:00 GMT+0000 (Coordinated Universal Time)",
        "",
    ]
    assert "\n".join(card[9:]) == '{\n  "k": [\n    1,\n    {\n      "b": "x"\n    }\n  ],\n  "z": {}\n}'
    text = shape.upsert_text(one).first().text.split("\n")
    assert text[0] == "Memory upserted." and text[3:5] == ["Tags: []", "Confidence: 0"]
    line = json_rows(one.select("id", F.lit(None).cast("string").alias("x"), "created_at")).first().value
    assert line == f'{{"id":"{uid(0)}","x":null,"created_at":"2024-01-01T00:00:00.000Z"}}'
    write_json(one.select("id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().id == uid(0)


def test_digests(spark, memories):
    lines = [r.line for r in shape.list_digest(memories.filter("type = 'a'")).collect()]
    count = memories.filter("type = 'a'").count()
    assert lines[0] == f"Found {count} memories:" and len(lines) == count + 1
    assert lines[1].startswith("• [a] tags=")
    assert [r.line for r in shape.list_digest(memories.filter("id = ''")).collect()] == ["No memories found."]
    hits = spark.createDataFrame(
        [(1, 2, "b", ["x", "y"], 0.5), (1, 1, "a", None, 1.0005)],
        "query_id int, rank int, type string, tags array<string>, similarity double",
    )
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    texts = {r.query_id: r.text for r in shape.search_digests(hits, queries).collect()}
    assert texts[1] == "Found 2 memories:\n• [a] sim=1.000 tags=\n• [b] sim=0.500 tags=x, y"
    assert texts[2] == "No memories found."


def test_long_argument_is_kept_whole(spark):
    tag = "x" * 1_200_000
    df = spark.createDataFrame([(f"mem://by-type/{tag}?limit=3",)], "uri string")
    assert browse.parse_addresses(df).first()["argument"] == tag


def test_refused_addresses(spark):
    uris = ["mem://recent", "mem://nowhere/x", "mem://recent?limit=x", "mem://by-tags/%zz"]
    df = spark.createDataFrame(list(enumerate(uris)), "request_id int, uri string")
    got = {r.request_id: r.error for r in browse.refused(df).collect()}
    assert got == {1: "Unknown resource: mem://nowhere/x", 2: "limit must be a number", 3: "URI malformed"}
