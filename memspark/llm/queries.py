"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import (
    bpe,
    chat,
    fill_middle,
    fingerprints,
    hard_negatives,
    html_extract,
    jaccard,
    licenses,
    mixing,
    quality,
    substring_dedup,
    token_counts,
    token_files,
)
from memspark.sources.scratch import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> tuple[str, str]:
    """Path and pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "licence_scan.*")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.histogram(table(spark, sf_dir, "documents"), *vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.limits(Workspace(spark).stage(lengths, "lengths"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"), Workspace(spark))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = html_extract.main_text(F.col("html"), html_extract.train(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = bpe.digest(F.col("text"), *vocabulary("byte_bpe_50k.tiktoken"))
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("d")).select("doc_id", "d.*")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    folder = space.path("tokens")
    path, _ = vocabulary("byte_bpe_50k.json")
    files = space.stage(token_files.write(table(spark, sf_dir, "documents"), folder, path), "files")
    return token_files.read(spark, files, folder)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = Workspace(spark).stage(mixing.document_sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), quality.fit(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "score", "base_failed", "kept"]
    return judged.select("doc_id", *[f"quality.{name}" for name in names])


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted, hard_negatives.quantised(F.col("embedding")).alias("q"))
    return hard_negatives.mine(rows, vec_id % 100 == 0, Workspace(spark))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_counts,
        op3_ngram_jaccard,
        op4_fingerprints,
        op5_chat_format,
        op6_html_text,
        op7_byte_bpe,
        op8_token_files,
        op9_mix_sources,
        op10_quality_rules,
        op11_substring_dedup,
        op12_fill_in_middle,
        op13_hard_negatives,
    )
}
