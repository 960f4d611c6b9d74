"""The training-data pipeline over ``documents``: STAGES are applied in order, each to what its
predecessor kept, with Parquet between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import bpe, jaccard, mixing, quality
from memspark.llm.queries import table, vocabulary
from memspark.sources.scratch import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. The model is fitted on ``docs`` and the labels, so
    an empty table or one without labels is judged by the base rules alone."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of linked documents: that of the smallest doc_id. Rows without doc_id
    come last; rows with the same doc_id and text are one document."""
    return jaccard.keep_first(docs, Workspace(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated by epochs, so that the words of each source come near its target;
    a document that the cut divides is taken if half of it or more lies before the cut."""
    return mixing.mixed_documents(docs, Workspace(spark))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row and what identifies them and their decoding; one row for each row of ``docs``."""
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.coded_rows(docs.select("doc_id", "source", "text"), "text", path, pattern)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_level_bpe),
]

ORACLE_SQL = None  # SQL has no byte-level BPE; tests hold the rows against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What the stages write lies in the cluster's shared folder."""
    space = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.stage(stage(spark, docs, sf_dir), name)
    return docs
