import hashlib
import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.functions import jsjson
from memspark.functions.canonical import (
    canonical_json,
    canonical_json_builtin,
    content_hash_hex,
    embedding_key,
    id_from_hash,
    unusual,
)
from memspark.functions.lexemes import lexemes
from memspark.functions.text import fixed3, js_number, js_trim, utf16_length

TEXTS = [
    ('{"b": 1, "a": [true, null, "x"]}', '{"a":[true,null,"x"],"b":1}'),
    ("1.0", "1"),
    ("1.50", "1.5"),
    ("-0", "0"),
    ("1e3", "1000"),
    ("1e21", "1e+21"),
    ("1e-7", "1e-7"),
    ("0.0000001", "1e-7"),
    ("0.000001", "0.000001"),
    ("123456789012345", "123456789012345"),
    ("12345678901234567890", "12345678901234567000"),
    ("[0.1234567890123456789]", "[0.12345678901234568]"),
    ("1e999", "null"),
    ('"\\u001b"', '"\\u001b"'),
    ('"\\ud83d"', '"\\ud83d"'),
    ('"\\ude00\\ud83d"', '"\\ude00\\ud83d"'),
    ('"\\ud83d\\ude00"', '"\U0001f600"'),
    ('"\\\\ud83d\\udc00"', '"\\\\ud83d\\udc00"'),
    ('"\\u00e9\\u2028/\x7f"', '"é /\x7f"'),
    ('{"\U0001f600":1,"￿":2,"a":3,"A":4,"":5}', '{"":5,"A":4,"a":3,"\U0001f600":1,"￿":2}'),
    ('{"k":1,"k":2}', '{"k":2}'),
    ("{bad", None),
    ("", None),
]


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_canonical_text(spark, allowed):
    """The same, whatever the session makes of keys that come twice."""
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", allowed)
    try:
        check_texts(spark)
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def check_texts(spark):
    df = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(TEXTS)], "raw string, n int")
    rows = {r.n: r.c for r in df.select("n", canonical_json(F.col("raw")).alias("c")).collect()}
    for n, (text, expected) in enumerate(TEXTS):
        assert rows[n] == expected, text


def test_field_of_a_document(spark):
    docs = ['{"content":{"b":1e3,"a":2}}', '{"content":{"b":1,"a":2}}', '{"x":1e3}', "5e3"]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "raw string, n int")
    out = df.select("n", canonical_json(F.col("raw"), F.try_parse_json("raw"), "content").alias("c"))
    assert [r.c for r in out.orderBy("n").collect()] == ['{"a":2,"b":1000}', '{"a":2,"b":1}', None, None]


values = st.recursive(
    st.none()
    | st.booleans()
    | st.integers(-(10**18), 10**18)
    | st.floats(allow_nan=False, allow_infinity=False)
    | st.text(st.characters(exclude_categories=["Cs"]), max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(values, min_size=20, max_size=20))
def test_builtin_and_exact_paths_agree(spark, sample):
    """Any JSON gives the text that Python works out alone, however the document is spelled."""
    spellings = [json.dumps(x, ensure_ascii=e) for x in sample for e in (True, False)]
    spellings = [s for s in spellings if all(ord(c) < 0xD800 or ord(c) > 0xDFFF for c in s)]
    df = spark.createDataFrame([(s,) for s in spellings], "raw string")
    for row in df.select("raw", canonical_json(F.col("raw")).alias("c")).collect():
        assert row.c == jsjson.stable_text(jsjson.parse(row.raw)), row.raw


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_text_reads_back(value):
    assert float(jsjson.number_text(value)) == value


def test_usual_text_stays_built_in(spark):
    texts = ['{"a":12.5,"b":"text with 3 words, 1.25 and caf\\u00e9 \\ud83d\\ude00"}', '{"id":123456789012345}']
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert [r[0] for r in df.select(unusual(F.col("raw"))).collect()] == [False, False]
    assert [r[0] for r in df.select(canonical_json_builtin(F.col("raw"))).collect()][1] == '{"id":123456789012345}'


def test_hashes(spark):
    rows = [("a::b", "c", "{}"), ("a", "b::c", "{}"), ("a", "b", "{}")]
    df = spark.createDataFrame(rows, "type string, source string, content string")
    digest = content_hash_hex(F.col("type"), F.col("source"), F.col("content"))
    got = [r[0] for r in df.select(digest).collect()]
    assert got[0] == got[1] == hashlib.sha256(b"a::b::c::{}").hexdigest() != got[2]
    one = df.limit(1).select(
        id_from_hash(F.unhex(digest)).alias("id"), embedding_key(F.lit("t"), "m").alias("key")
    ).first()
    h = got[0]
    assert one.id == f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
    assert one.key == hashlib.sha256(b"t").hexdigest() + "::m"


def test_text_functions(spark):
    df = spark.createDataFrame([("﻿  a b\t ", "x\U0001f600y")], "s string, u string")
    row = df.select(js_trim(F.col("s")).alias("t"), utf16_length(F.col("u")).alias("n")).first()
    assert (row.t, row.n) == ("a b", 4)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False) | st.floats(-4, 4), min_size=30, max_size=30))
def test_number_columns(spark, numbers):
    numbers += [0.0, -0.0, 1.0, 1e21, 1e-7, 1.0005, 2.0005, 0.0005, 0.9995, 1.9999, -0.0004]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for row in df.select("x", js_number(F.col("x")).alias("j"), fixed3(F.col("x")).alias("f")).collect():
        assert float(row.j) == row.x
        if 1 / 256 <= abs(row.x) < 4:
            assert row.f == exact_fixed3(row.x)


def exact_fixed3(value):
    """Half away from zero on the exact binary value."""
    return str(Decimal(value).quantize(Decimal("0.001"), ROUND_HALF_UP))


def test_fixed_decimals_next_to_every_half(spark):
    scores = [round(n / 1000 + 0.0005, 6) for n in range(10, 3000)]
    df = spark.createDataFrame([(x,) for x in scores], "x double")
    for row in df.select("x", fixed3(F.col("x")).alias("f")).collect():
        assert row.f == exact_fixed3(row.x), row.x


@pytest.mark.parametrize("value, text", [(1.0005, "1.000"), (1.0015, "1.002"), (0.5, "0.500"), (2.0, "2.000"), (0.0625, "0.063")])
def test_fixed_decimals(spark, value, text):
    assert spark.range(1).select(fixed3(F.lit(value))).first()[0] == text


def test_lexemes(spark):
    rows = [('{"text":"B a\\nb a"}', "Src"), ("", ""), (None, "x"), ('"---"', None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "content string, source string, n int")
    out = df.orderBy("n").select(lexemes(F.col("content"), F.col("source")).alias("l")).collect()
    found = [[(e.lexeme, e.positions) for e in r.l] for r in out]
    assert found[0] == [("a", [3, 5]), ("b", [2]), ("nb", [4]), ("src", [6]), ("text", [1])]
    assert found[1:] == [[], [("x", [1])], []]


def test_missing_part_gives_no_hash(spark):
    df = spark.createDataFrame([("t", "s", "1"), ("t", "s", None), (None, "s", "1")], "a string, b string, c string")
    got = [r[0] for r in df.select(content_hash_hex(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] and got[1] is None and got[2] is None
