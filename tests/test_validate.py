import json

import pytest

from memspark import Options
from memspark.operators import validate as v
from memspark.sources.requests import MALFORMED, malformed, parse_lines


def request(**changes):
    fields = {"type": "note", "content": {"a": 1}, "source": "app", "confidence": 0.5, "tags": []}
    fields.update(changes)
    return {k: x for k, x in fields.items() if x is not ...}


def run(spark, lines, check=v.check_creates, **how):
    rows = [(line if isinstance(line, str) else json.dumps(line), i) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "raw string, seq long").repartition(1).sortWithinPartitions("seq")
    out = check(parse_lines(df), **how).collect()
    return sorted(out, key=lambda r: r.seq)


CASES = [
    (request(type=...), v.TYPE_REQUIRED),
    (request(type=5), v.TYPE_REQUIRED),
    (request(type=" "), v.TYPE_REQUIRED),
    (request(type="﻿\t "), v.TYPE_REQUIRED),
    (request(type=None), v.TYPE_REQUIRED),
    (request(content=...), v.CONTENT_REQUIRED),
    (request(content=None), v.CONTENT_REQUIRED),
    (request(content=False), v.CONTENT_REQUIRED),
    (request(content=0), v.CONTENT_REQUIRED),
    ('{"type":"t","content":-0.0,"source":"s","confidence":1}', v.CONTENT_REQUIRED),
    ('{"type":"t","content":0e5,"source":"s","confidence":1}', v.CONTENT_REQUIRED),
    (request(content=""), v.CONTENT_REQUIRED),
    (request(content={}), None),
    (request(content=[]), None),
    (request(content="x"), None),
    (request(content=True), None),
    (request(source=...), v.SOURCE_REQUIRED),
    (request(source=" \n"), v.SOURCE_REQUIRED),
    (request(confidence=...), v.CONFIDENCE_REQUIRED),
    (request(confidence="0.5"), v.CONFIDENCE_REQUIRED),
    (request(confidence=-0.1), v.CONFIDENCE_REQUIRED),
    (request(confidence=1.1), v.CONFIDENCE_REQUIRED),
    (request(confidence=True), v.CONFIDENCE_REQUIRED),
    ('{"type":"t","content":1,"source":"s","confidence":1e999}', v.CONFIDENCE_REQUIRED),
    (request(confidence=0), None),
    (request(confidence=1), None),
    ('{"type":"t","content":1,"source":"s","confidence":1e-1}', None),
    (request(tags=None), v.TAGS_NOT_ARRAY),
    (request(tags="a"), v.TAGS_NOT_ARRAY),
    (request(tags=...), None),
    (request(tags=["a"] * 20), None),
    (request(tags=["a"] * 21), v.TAGS_TOO_MANY.format(20)),
    (request(tags=["ok", "a b", "c d"]), 'invalid tag: "a b"'),
    (request(tags=[""]), 'invalid tag: ""'),
    (request(tags=["x" * 100]), None),
    (request(tags=["x" * 101]), f'invalid tag: "{"x" * 101}"'),
    (request(tags=["abc\u0085"]), 'invalid tag: "abc\u0085"'),
    (request(tags=[{"a": 1}]), 'invalid tag: "{"a":1}"'),
    (request(content="x" * 9998), None),
    (request(content="x" * 9999), v.CONTENT_TOO_LARGE.format(10000)),
    (request(content="\U0001f600" * 4999), None),
    (request(content="\U0001f600" * 4999 + "x"), v.CONTENT_TOO_LARGE.format(10000)),
    (request(type=" ", tags=["a b"]), v.TYPE_REQUIRED),
    (request(content="x" * 9999, tags=["a b"]), v.CONTENT_TOO_LARGE.format(10000)),
    ("{bad", MALFORMED),
    ('{"a":1} x', MALFORMED),
    ('{"a":1}] x', MALFORMED),
    ('{"a":1},{"b":2}', MALFORMED),
    ("", MALFORMED),
    ("5", v.TYPE_REQUIRED),
    ("null", v.TYPE_REQUIRED),
    ("[1]", v.TYPE_REQUIRED),
]


def test_golden_requests(spark):
    for (line, expected), row in zip(CASES, run(spark, [c[0] for c in CASES])):
        assert row.error == expected, line


def test_clean_fields(spark):
    rows = run(
        spark,
        [
            request(tags=[" A ", "a", "b"]),
            request(tags=[1, None, True, 1.5]),
            '{"type":"t","content":1,"source":"s","confidence":1,"tags":[1e3, 1e21]}',
            request(type=" " + "x" * 49 + " more", source=" " + "s" * 120),
            '{"type":"a","content":{"k":1,"k":2},"source":"s","confidence":1}',
            ' {"type":"a","content":{"b":1,"a":2},"source":"s","confidence":1}\t',
        ],
    )
    assert rows[0].tags == ["a", "b"]
    assert rows[1].tags == ["1", "null", "true", "1.5"]
    assert rows[2].error == 'invalid tag: "1e+21"'
    assert rows[3].type == "x" * 49 + " " and rows[3].source == "s" * 100
    assert rows[4].content == '{"k":2}'
    assert rows[5].content == '{"a":2,"b":1}'


def test_limits_are_options(spark):
    options = Options.of({"max_tags": "1", "max_content_length": 5})
    rows = run(spark, [request(tags=["a", "b"]), request(content="12345")], options=options)
    assert rows[0].error == v.TAGS_TOO_MANY.format(1)
    assert rows[1].error == v.CONTENT_TOO_LARGE.format(5)


@pytest.mark.parametrize(
    "given, expected",
    [("", 10), (None, 10), ("x", 10), ("7", 7), ("7 rows", 7), ("0", 1), (-3, 1), ("1000", 100)],
)
def test_option_clamping(given, expected):
    assert Options.of({"default_limit": given}).default_limit == expected


def test_unknown_option():
    with pytest.raises(ValueError):
        Options.of({"nope": 1})


def test_rejects_keep_the_raw_line(spark):
    lines = ["{" + "x" * 200, json.dumps(request(type=" "))]
    df = spark.createDataFrame([(x, 0) for x in lines], "raw string, seq long")
    parsed = parse_lines(df)
    found = {r.raw: r.error for r in v.rejects(v.check_creates(parsed)).collect()}
    assert found == {("{" + "x" * 99): MALFORMED, lines[1]: v.TYPE_REQUIRED}
    assert [r.raw for r in malformed(parsed).collect()] == ["{" + "x" * 99]


def test_searches(spark):
    cases = [
        ({"query": " find ", "limit": 3}, (None, "find", None, None, 3)),
        ({"query": "q"}, (None, "q", None, None, 10)),
        ({"query": "q", "limit": 500}, (None, "q", None, None, 100)),
        ('{"query":"q","limit":1e999}', (None, "q", None, None, 100)),
        ({"query": "q", "limit": 150.5}, (None, "q", None, None, 100)),
        ({"query": "q", "limit": 2.5}, (v.LIMIT_FRACTION,)),
        ({"query": "q", "limit": 0}, (v.LIMIT_NOT_POSITIVE,)),
        ({"query": "q", "limit": None}, (v.LIMIT_NOT_POSITIVE,)),
        ({"query": "q", "limit": "5"}, (v.LIMIT_NOT_POSITIVE,)),
        ({"query": "  "}, (v.QUERY_REQUIRED,)),
        ({"query": 5}, (v.QUERY_REQUIRED,)),
        ({"query": "x" * 1000}, (None, "x" * 1000, None, None, 10)),
        ({"query": "x" * 1001}, (v.QUERY_TOO_LONG,)),
        ({"query": "q", "type": ""}, (None, "q", None, None, 10)),
        ({"query": "q", "type": 0}, (None, "q", None, None, 10)),
        ({"query": "q", "type": "  "}, (v.TYPE_REQUIRED,)),
        ({"query": "q", "type": 7}, (v.TYPE_REQUIRED,)),
        ({"query": "q", "tags": ["A", "a"]}, (None, "q", None, ["a", "a"], 10)),
        ({"query": "q", "tags": []}, (None, "q", None, [], 10)),
        ({"query": "q", "tags": ["a"] * 50}, (None, "q", None, ["a"] * 50, 10)),
        ({"query": "q", "tags": "a"}, (v.TAGS_NOT_ARRAY,)),
        ({"query": "q", "tags": None}, (None, "q", None, None, 10)),
        ({"query": "q", "tags": ["!"]}, ('invalid tag: "!"',)),
        ({"query": "", "limit": 0}, (v.QUERY_REQUIRED,)),
    ]
    for (line, expected), row in zip(cases, run(spark, [c[0] for c in cases], v.check_searches)):
        got = (row.error, row.query, row.type, row.tags, row.limit)
        assert got[: len(expected)] == expected, line


def test_lists(spark):
    cases = [
        ({}, (None, None, None)),
        ({"type": " a "}, (None, "a", None)),
        ({"type": " "}, (v.TYPE_BLANK,)),
        ({"type": 3}, (v.TYPE_BLANK,)),
        ({"tags": ["X"]}, (None, None, ["x"])),
        ({"tags": {"a": 1}}, (v.TAGS_NOT_ARRAY,)),
    ]
    for (line, expected), row in zip(cases, run(spark, [c[0] for c in cases], v.check_lists)):
        assert (row.error, row.type, row.tags)[: len(expected)] == expected, line


def test_ids(spark):
    good = "0123abcd-0123-0123-0123-0123456789AB"
    cases = [(f" {good}\n", None), ("", v.ID_REQUIRED), (None, v.ID_REQUIRED), ("x", v.ID_INVALID), (good + "\u0085", v.ID_INVALID)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, id string")
    rows = {r.n: r for r in v.check_ids(df).collect()}
    assert [rows[i].error for i in range(len(cases))] == [c[1] for c in cases]
    assert rows[0].id == good
