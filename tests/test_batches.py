"""Work on batches of long texts in parts."""

import pyarrow as pa

from memspark.functions import lexemes


def test_lexemes_are_made_in_parts(monkeypatch):
    texts = pa.array(["b a b", None, "", "x" * 50, "c, d c"] * 7).slice(2)
    whole = lexemes._words_with_positions(texts).to_pylist()
    sizes = []
    one = lexemes._words_with_positions
    monkeypatch.setattr(lexemes, "_words_with_positions", lambda part: sizes.append(len(part)) or one(part))
    monkeypatch.setattr(lexemes, "SLICE", 64)
    assert lexemes._sliced(texts).to_pylist() == whole
    assert len(sizes) > 5 and sum(sizes) == len(texts)
    assert lexemes._sliced(texts.slice(0, 0)).to_pylist() == []


def test_staged_tables_are_packed(spark):
    from memspark.sources.scratch import Workspace

    space = Workspace(spark)
    staged = space.stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert all(name.endswith(".zstd.parquet") for name in staged.inputFiles())
