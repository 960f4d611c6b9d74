import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from memspark import Options
from memspark.functions.canonical import embedding_key
from memspark.functions.vectors import l2_normalize, mean_pool, width_ok
from memspark.operators.embed import (
    EMBEDDING_FAILED,
    HashingEmbedder,
    distinct_texts,
    embed_once,
    embed_texts,
    pool_tokens,
    vector_error,
)
from memspark.operators import embed
from memspark.operators.skew import join_salted

OPTIONS = Options(dim=16, embed_retries=1)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fragile:
    """Fails for some texts, gives a wrong width for others, and records every text it sees."""

    model = "fragile"

    def __init__(self, log):
        self.log = log

    def encode(self, texts, pooling, normalize):
        with open(self.log, "a") as out:
            out.writelines(f"{t}\n" for t in texts)
        if any(t == "bad" for t in texts):
            raise RuntimeError("no")
        return [np.full(3 if t == "short" else 16, np.nan if t == "nan" else 0.25) for t in texts]


def texts_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")


def test_failures_are_rows(spark, tmp_path):
    df = texts_df(spark, ["ok", "bad", "short", "nan", "ok", "ok"])
    out = embed_once(df, "text", Fragile(str(tmp_path / "log")), OPTIONS, spread_by=["n"], pause=0.0)
    rows = {r.n: r for r in out.collect()}
    assert [rows[i].embed_error for i in range(6)] == [
        None,
        EMBEDDING_FAILED,
        "expected 16 dimensions, not 3",
        "NaN not allowed in vector",
        None,
        None,
    ]
    assert rows[0].embedding == rows[4].embedding == [0.25] * 16 and rows[1].embedding is None


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    texts = ["same"] * 200 + [f"t{i}" for i in range(40)]
    df = texts_df(spark, texts).repartition(4)
    embedder = Fragile(str(log))
    out = embed_once(df, "text", embedder, OPTIONS, spread_by=["n"])
    assert out.count() == out.filter("embedding is not null").count() == 240
    assert sorted(log.read_text().split()) == sorted(set(texts))
    stored = out.select(embedding_key(F.col("text"), "fragile").alias("embed_key"), "embedding").distinct()
    more = texts_df(spark, ["same", "t3", "new"])
    again = embed_once(more, "text", embedder, OPTIONS, spread_by=["n"], stored=stored)
    assert again.filter("embedding is not null").count() == 3
    assert log.read_text().split()[41:] == ["new"]


def test_hot_key_is_spread(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    lookup = counts.select("k", F.upper("k").alias("v"))
    joined = join_salted(rows, lookup, "k", counts, ["id"])
    assert joined.columns == ["k", "id", "v"]
    assert joined.count() == 3000 and joined.filter(F.col("v") == F.upper("k")).count() == 3000
    missing = join_salted(rows, lookup.filter("k <> 'hot'"), "k", counts, ["id"])
    assert missing.count() == 3000 and missing.filter("v is null").count() == 1000
    inner = join_salted(rows, lookup.filter("k = 'hot'"), "k", counts, ["id"], how="inner")
    assert inner.count() == 1000


def test_distinct_texts(spark):
    out = distinct_texts(texts_df(spark, ["a", "b", "a"]), "text", "m").collect()
    assert {r.text: r.n for r in out} == {"a": 2, "b": 1}


def test_hashing_embedder():
    embedder = HashingEmbedder(32)
    texts = ["The cat sat", "the CAT, sat!", "dog", "", "--"]
    vectors = embedder.encode(texts)
    assert np.array_equal(vectors[0], vectors[1])
    assert np.allclose(np.linalg.norm(vectors, axis=1), [1, 1, 1, 0, 0])
    raw = embedder.encode(texts, normalize=False)
    assert np.isclose(np.abs(raw[0]).sum(), 1.0)
    first = embedder.encode(["the dog", "the"], pooling="cls")
    assert np.array_equal(first[0], first[1])
    assert np.array_equal(embedder.encode(texts[2:3]), vectors[2:3])
    with pytest.raises(ValueError):
        embedder.encode(texts, pooling="max")


def test_pool_tokens():
    tokens = np.array([[1.0, 0.0], [3.0, 2.0], [5.0, 5.0]])
    assert pool_tokens(tokens, [2, 0, 1], "mean").tolist() == [[2, 1], [0, 0], [5, 5]]
    assert pool_tokens(tokens, [2, 0, 1], "cls").tolist() == [[1, 0], [0, 0], [5, 5]]
    with pytest.raises(ValueError):
        pool_tokens(tokens, [3], "max")


def test_vector_errors():
    assert vector_error(np.zeros(4), 4) is None
    assert vector_error(None, 4) == EMBEDDING_FAILED
    assert vector_error(np.array([np.inf] * 4), 4) == "infinite value not allowed in vector"


def test_retry_then_success(spark, tmp_path):
    class Flaky:
        model = "flaky"

        def __init__(self, mark):
            self.mark = mark

        def encode(self, texts, pooling, normalize):
            import os

            if not os.path.exists(self.mark):
                open(self.mark, "w").close()
                raise RuntimeError("first call")
            return np.ones((len(texts), 16))

    texts = distinct_texts(texts_df(spark, ["a", "b"]).coalesce(1), "text", "flaky").coalesce(1)
    out = embed_texts(texts, Flaky(str(tmp_path / "mark")), OPTIONS, pause=0.0)
    assert out.filter("error is not null").count() == 0


def test_vector_columns(spark):
    df = spark.createDataFrame(
        [(1, [3.0, 4.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "k int, embedding array<float>"
    )
    units = df.select(l2_normalize(F.col("embedding")).alias("u")).collect()
    assert np.allclose(units[0].u, [0.6, 0.8], atol=1e-9) and units[2].u == [0.0, 0.0]
    means = {r.k: r.embedding for r in mean_pool(df, ["k"], "embedding").collect()}
    assert means == {1: [2.0, 2.0], 2: [0.0, 0.0]}
    bad = spark.createDataFrame([([1.0],), ([1.0, None],), (None,), ([1.0, 2.0],)], "e array<float>")
    assert [r[0] for r in bad.select(width_ok(F.col("e"), 2)).collect()] == [False, False, False, True]


def test_words_are_split_without_compiling_a_pattern_for_each_call(monkeypatch):
    import pyarrow.compute as pc

    texts = ["Blue paint, 2 tins!", "", None, "\n xéY中١ _a-b", "..."]
    pieces = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.string())), r"[^\p{L}\p{N}]+").to_pylist()
    words, rows = embed._words(texts)
    expected = [(n, word) for n, parts in enumerate(pieces) for word in parts or [] if word]
    assert list(zip(rows.tolist(), words.to_pylist())) == expected

    def compiled(*args, **how):
        raise AssertionError("a pattern was compiled")

    for name in ("split_pattern_regex", "match_substring_regex"):
        monkeypatch.setattr(pc, name, compiled)
    assert np.allclose(np.linalg.norm(HashingEmbedder(8).encode(["one two"]), axis=1), 1.0)


def test_first_time_failing_does_not_hold_texts():
    from registry.embedders import FirstTimeFailing

    model = FirstTimeFailing(8)
    with pytest.raises(RuntimeError):
        model.encode(["x" * 10_000, "y"])
    assert model.encode(["x" * 10_000, "y"]).shape == (2, 8)
    assert len(model.met) == 2 and all(len(key) == 16 for key in model.met)
