"""Quality rules: counts of a text's faults, and how much its n-grams look like trusted text.

The score of a document is the log-likelihood ratio of its character n-grams between two
multinomials over hashed n-grams, divided by their number. One multinomial is counted over trusted
documents (labelled of good quality), the other over all documents. Weights are
rounded to whole units of 1/SCALE, so a score is a sum of integers: the same in every
order, partition and retry. Every document is held against one threshold.

Passes over the documents: one for the counts, one that scores the labelled documents to set
the threshold, and the one that gives the result. None shuffles texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.memory import tidy
from memspark.llm.words import SEPARATOR, Words, slices, utf8

GRAM = 3  # characters
BUCKETS = 1 << 16
SCALE = 1 << 16
MULTIPLIERS = (2654435761, 2246822519, 3266489917)  # odd, below 2**32; fixed values of the hash
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words
LABELLED = 20_000  # labelled documents used for the fit, at most

FACTS = pa.schema(
    [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "score")]
)
FACTS_DDL = ", ".join(f"{name} long" for name in FACTS.names)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every run of GRAM characters of every text."""
    codes = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts]
    counts = np.array([len(c) for c in codes], np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    n = max(0, len(code) - GRAM + 1)
    value = np.zeros(n, np.uint32)
    for j, multiplier in enumerate(MULTIPLIERS):
        value += code[j : j + n] * np.uint32(multiplier)
    row = np.repeat(np.arange(len(texts)), counts)
    inside = row[:n] == row[GRAM - 1 :] if n else np.zeros(0, bool)
    return row[:n][inside], (value >> np.uint32(16))[inside]


def _repeated_words(words: Words, rows: int) -> np.ndarray:
    at, value = words.windows(WINDOW)
    own = value ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.hash), bool)
    for j in range(WINDOW):
        covered[at[twice] + j] = True
    return np.bincount(words.doc[covered], minlength=rows)


def _repeated_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def facts(texts: pa.Array, weights: np.ndarray) -> list[np.ndarray]:
    """The columns of FACTS for a column of texts."""
    data, offsets = utf8(texts)
    rows = len(offsets) - 1
    words = Words(data, offsets, lower=False)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    plain = texts.to_pylist()
    row, bucket = grams(plain)
    edges = np.searchsorted(row, np.arange(rows + 1))
    score = np.concatenate([[0], np.cumsum(weights[bucket])])
    return [
        words.count,
        _sums(~SEPARATOR[data] & ((data & 0xC0) != 0x80), offsets),
        _sums(symbol[data], offsets),
        np.array([_repeated_lines(t) for t in plain], np.int64),
        _repeated_words(words, rows),
        np.diff(edges),
        score[edges[1:]] - score[edges[:-1]],
    ]


def _fact_column(text: Column, weights: np.ndarray) -> Column:
    @tidy
    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            batch = pa.record_batch([column], ["text"])
            parts = [facts(part.column(0), weights) for part in slices(batch, "text")]
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(FACTS)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(FACTS))

    return F.arrow_udf(work, FACTS_DDL).asNondeterministic()(text)


@dataclass(frozen=True)
class Model:
    """``weights`` in units of 1/SCALE for each bucket; a text passes at ``threshold`` or above."""

    weights: np.ndarray
    threshold: float

    def passes(self, score: Column, n_grams: Column) -> Column:
        return score / F.greatest(n_grams, F.lit(1)) >= F.lit(self.threshold)


def sample_labels(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, chosen by a hash of the id: (doc_id, good).

    Rows without id or quality count for nothing; an id labelled both ways counts as bad.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).dropna()
    one = known.groupBy("doc_id").agg(F.min("good").alias("good"))
    return one.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)


def _count(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """n-grams per bucket over all documents and over the trusted ones: shape (2, BUCKETS)."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                trusted = np.array([g == 1 for g in part.column("good").to_pylist()], bool)
                row, bucket = grams(part.column("text").to_pylist())
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                counts[1] += np.bincount(bucket[trusted[row]], minlength=BUCKETS)
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "raw", "trusted"]
        )

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "good")
    rows = joined.mapInArrow(work, "bucket int, raw long, trusted long")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():
        out[:, r["bucket"]] = r["raw"], r["trusted"]
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    (raw, trusted), (all_raw, all_trusted) = counts, counts.sum(axis=1)
    if not all_trusted:
        return np.zeros(BUCKETS, np.int64)
    return np.array(
        [
            math.floor((math.log((t + 1) / (all_trusted + BUCKETS)) - math.log((r + 1) / (all_raw + BUCKETS))) * SCALE + 0.5)
            for r, t in zip(raw.tolist(), trusted.tolist())
        ],
        np.int64,
    )


def _threshold(scored: list[tuple[float, int, int]]) -> float:
    """The cut with the best balanced accuracy; the lowest such cut, so that clean texts stay. ``scored`` has
    (score, good or not, number of rows).

    Without bad examples it is the lowest good score; without good ones nothing is cut.
    """
    good = sum(g * n for _, g, n in scored)
    bad = sum(n for *_, n in scored) - good
    if not good:
        return -math.inf
    scored = sorted(scored)
    best, cut, good_below, bad_below = -1.0, scored[0][0], 0, 0
    for i, (score, is_good, n) in enumerate(scored):
        if i and score > scored[i - 1][0]:
            value = (good - good_below) / good + (bad_below / bad if bad else 0)
            if value > best:
                best, cut = value, (score + scored[i - 1][0]) / 2
        elif not i:
            best, cut = 1.0, score
        good_below += is_good * n
        bad_below += (1 - is_good) * n
    return cut


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    """Weights from all documents and the threshold from the labelled ones that pass the base rules."""
    sample = sample_labels(labels, limit)
    weights = _weights(_count(docs, sample))
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    seen = labelled.select("good", _fact_column(F.col("text"), weights).alias("f")).filter(
        ~base_failed(F.col("f.n_words"), F.col("f.n_repeat_words"))
    )
    # repeated rows of a labelled id are counted before they are gathered
    mean = (F.col("f.score") / F.greatest("f.n_grams", F.lit(1))).alias("mean")
    rows = seen.select(mean, "good").groupBy("mean", "good").count().collect()
    return Model(weights, _threshold([(float(s), int(g), int(n)) for s, g, n in rows]))


def judge(docs: DataFrame, model: Model, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: counts, score, base_failed and kept.

    A null or empty text has no words, so it fails the base rules. Rows are judged one by one:
    repeated rows get equal verdicts, and ids play no part.
    """
    raw = f"__{into}_facts"
    found = docs.withColumn(raw, _fact_column(F.col("text"), model.weights))
    fact = {name: F.col(f"{raw}.{name}") for name in FACTS.names}
    failed = base_failed(fact["n_words"], fact["n_repeat_words"])
    verdict = F.struct(
        *[column.alias(name) for name, column in fact.items()],
        failed.alias("base_failed"),
        (~failed & model.passes(fact["score"], fact["n_grams"])).alias("kept"),
    )
    return found.withColumn(into, verdict).drop(raw)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they are."""
    verdict = "__quality_rules"
    return judge(docs, model, verdict).filter(F.col(f"{verdict}.kept")).drop(verdict)
