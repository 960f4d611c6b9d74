"""The given tables seen as requests, writes and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.canonical import canonical_json_builtin, id_from_hash
from memspark.functions.vectors import l2_normalize, mean_pool
from memspark.operators.merge import fold, with_identity

DIM = 64  # width of the vectors in ``embeddings``


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_writes(events: DataFrame) -> DataFrame:
    """Every event as a write: its props are the content, its user the tag."""
    return with_identity(
        events.select(
            F.col("event_type").alias("type"),
            canonical_json_builtin(F.col("props")).alias("content"),
            F.lit("app").alias("source"),
            F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("tags"),
            (F.col("value") / 500).alias("confidence"),
            "ts",
            F.col("event_id").alias("seq"),
        )
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(event_writes(table(spark, sf_dir, "events")), hashed=True)


def event_lines(events: DataFrame) -> DataFrame:
    """Every event as a create request line."""
    request = F.struct(
        F.col("event_type").alias("type"),
        F.from_json("props", "k int").alias("content"),
        F.lit("app").alias("source"),
        F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("tags"),
        (F.col("value") / 500).alias("confidence"),
    )
    return events.select(F.to_json(request).alias("raw"), "ts", F.col("event_id").alias("seq"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a create request line; some kinds of document make a faulty request."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    quoted = F.contains("text", F.lit('"'))
    good, toxic = F.coalesce("quality", F.lit(-1)), F.coalesce("toxic", F.lit(0))
    request = F.struct(
        F.when(F.col("n_chars") < 20, "   ").otherwise(F.concat(F.lit(" "), "lang", F.lit("\t"))).alias("type"),
        F.struct("text").alias("content"),
        F.when(~((good == 0) & (toxic == 1)), F.col("source")).alias("source"),
        F.concat(
            F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source"), F.col("lang")),
            F.when(quoted, F.array(F.concat_ws(" ", "source", "lang"))).otherwise(F.array().cast("array<string>")),
        ).alias("tags"),
        F.when((good == 1) & (toxic == 1), 1.5).when(good == 1, 0.9).when(good == 0, 0.4).otherwise(0.5).alias("confidence"),
    )
    broken = F.col("n_chars").between(20, 39)
    raw = F.concat(F.to_json(request), F.when(broken, " x").otherwise(""))
    return docs.select(raw.alias("raw"), F.col("doc_id").alias("seq"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their content as canonical text."""
    return table(spark, sf_dir, "documents").withColumn(
        "content", canonical_json_builtin(F.to_json(F.struct("text")))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as records that have only an id."""
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def typed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors with the language and source of the document of the same number."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.array("lang", "source").alias("tags"), "source"
    )
    return vectors(spark, sf_dir).join(docs, "id")


def centroid(spark: SparkSession, sf_dir: str) -> list[float]:
    """Mean direction of all vectors: one row of fixed width."""
    one = mean_pool(vectors(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "embedding")
    return one.select(l2_normalize(F.col("embedding")).alias("v")).first()["v"]


def uuid_of_text(text: Column) -> Column:
    return id_from_hash(F.unhex(F.sha2(text, 256)))


def flat(df: DataFrame) -> DataFrame:
    """Tags and hashes as plain text, so that rows compare the same way in every engine."""
    if "tags" in df.columns:
        df = df.withColumn("tags", F.array_join("tags", ","))
    if "content_hash" in df.columns:
        df = df.withColumn("content_hash", F.lower(F.hex("content_hash")))
    return df
