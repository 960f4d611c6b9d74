"""Token counts: an exact histogram of encoded lengths, and what follows from it for every limit.

For a context limit the tokens of all documents, cut to the limit, are the tokens of the
documents up to it plus the limit for every longer one. Both are sums over the histogram, so they
are worked out once for each length that occurs; between two such lengths the truncated total is linear
and the rest stays the same.

The histogram has a row for each length: documents are added up before the shuffle. Its running sums
are taken in ranges of STEP lengths; ranges are added up first, then the rows within each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.bpe import read_ranks
from memspark.llm.chunks import Memory
from memspark.llm.words import slices

STEP = 4096


class Counter:
    """Number of tokens of a text; each part of a text is encoded once."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.parts = Memory(lambda parts: [len(encoding.encode_ordinary(part)) for part in parts])

    def count(self, texts: pa.Array) -> np.ndarray:
        return self.parts.sums(texts)


@cache
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def n_tokens(text: Column, path: str, pattern: str) -> Column:
    """Encoded length; 0 for null and empty texts."""

    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path, pattern)
        for column in texts:
            batch = pa.record_batch([column], ["text"])
            counts = [own.count(part.column(0)) for part in slices(batch, "text")]
            yield pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))

    return F.arrow_udf(work, "long").asNondeterministic()(text)


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, documents): a row for each encoded length. An empty table has no rows."""
    return docs.select(n_tokens(F.col("text"), path, pattern).alias("n_tokens")).groupBy("n_tokens").agg(
        F.count("*").alias("documents")
    )


def limits(lengths: DataFrame) -> DataFrame:
    """A row for each length L of a histogram: documents and tokens up to L, documents longer than L,
    the total when documents are cut at L, and the share of documents up to L (the quantile that L is).

    ``lengths`` is read twice and should be a written table.
    """
    rows = lengths.withColumn("step", F.floor(F.col("n_tokens") / STEP)).withColumn("tokens", F.col("n_tokens") * F.col("documents"))
    steps = rows.groupBy("step").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    lower, higher = (Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in ("step", F.desc("step")))
    none = F.lit(0).cast("long")
    steps = steps.select(
        "step",
        F.coalesce(F.sum("d").over(higher), none).alias("d_above"),
        F.coalesce(F.sum("t").over(lower), none).alias("t_below"),
        F.sum("d").over(Window.partitionBy()).alias("all_documents"),
    )
    up = Window.partitionBy("step").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("step").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(steps, "step")
    longer = F.col("d_above") + F.coalesce(F.sum("documents").over(down), none)
    upto = F.col("t_below") + F.sum("tokens").over(up)
    out = joined.select("n_tokens", "documents", "all_documents", longer.alias("documents_longer"), upto.alias("tokens_upto"))
    return out.select(
        "n_tokens",
        "documents",
        "documents_longer",
        "tokens_upto",
        (F.col("tokens_upto") + F.col("n_tokens") * F.col("documents_longer")).alias("truncated_total"),
        (1 - F.col("documents_longer") / F.col("all_documents")).alias("share_upto"),
    )


def quantile(answers: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the documents do not exceed; None for an empty table."""
    return answers.filter(F.col("share_upto") >= share).agg(F.min("n_tokens")).first()[0]


def truncated_total(answers: DataFrame, limit: int) -> int:
    """Tokens of all documents when each is cut to ``limit``, from the rows next to the limit."""
    upto = answers.filter(F.col("n_tokens") <= limit).agg(
        F.max_by("tokens_upto", "n_tokens").alias("t"), F.max_by("documents_longer", "n_tokens").alias("d")
    )
    tokens, longer = upto.first()
    if longer is None:  # every document is longer
        longer, tokens = answers.agg(F.sum("documents")).first()[0] or 0, 0
    return tokens + limit * longer
