"""Upsert by content hash as one fold, shared by batch, table and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.canonical import content_hash, id_from_hash

FIRST_WRITER = ["id", "type", "content", "source", "lexemes"]
WIDE = [*FIRST_WRITER, "embedding"]


def with_identity(writes: DataFrame, keep: list[str] = []) -> DataFrame:
    """Add content hash, id and row defaults to sanitised writes.

    Expects type, content (canonical text), source, tags, confidence, ``ts``
    and ``seq``; (ts, seq) orders all writes. A write without type, source or
    content has no identity and fails the job; checked requests always have them.
    Columns named in ``keep`` are carried along.
    """
    refused = F.raise_error(F.lit("a write needs type, source and content")).cast("binary")
    digest = F.coalesce(content_hash(F.col("type"), F.col("source"), F.col("content")), refused)
    hashed = writes.withColumn("content_hash", digest)
    return hashed.select(
        "content_hash",
        id_from_hash(F.col("content_hash")).alias("id"),
        "type",
        "content",
        "source",
        *(["embedding"] if "embedding" in writes.columns else []),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        "confidence",
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.col("seq").alias("first_seq"),
        *keep,
    )


def merge_columns(rows: DataFrame):
    """The merge as aggregate columns over one row per tag.

    Tags united, highest confidence, earliest creation, latest update, all
    other fields from the first writer; the vector from the first writer that
    brought one, since writes of a known record come without. Every part combines on the map side, so
    a hash that holds most of the rows sends one row per task; the final tag
    set is as large as the merged record itself and no larger.
    """
    fields = [name for name in FIRST_WRITER if name in rows.columns]
    order = F.struct("created_at", "first_seq")
    head = F.col("__pos") == 0
    vector = []
    if "embedding" in rows.columns:
        vector = [F.min_by("embedding", F.when(F.col("embedding").isNotNull(), order)).alias("embedding")]
    return [
        *vector,
        F.min_by(F.when(head, F.struct(*fields)), F.when(head, order)).alias("__first"),
        F.min(F.when(head, order)).alias("__order"),
        F.array_sort(F.collect_set("__tag")).alias("tags"),
        F.max("confidence").alias("confidence"),
        F.max("updated_at").alias("updated_at"),
    ]


def one_row_per_tag(records: DataFrame) -> DataFrame:
    """Spread the tags; only the first row of a record keeps the wide fields."""
    fields = [name for name in WIDE if name in records.columns]
    spread = records.select(
        *[name for name in records.columns if name != "tags"],
        F.posexplode_outer("tags").alias("__pos", "__tag"),
    ).withColumn("__pos", F.coalesce("__pos", F.lit(0)))
    wide = {name: F.when(F.col("__pos") == 0, F.col(name)) for name in fields}
    return spread.withColumns(wide)


def merged_rows(groups: DataFrame, columns: list[str]) -> DataFrame:
    """Aggregate output of ``merge_columns`` as record columns."""
    return groups.select("*", "__first.*").select(
        *[
            F.col(f"__order.{name}").alias(name) if name in ("created_at", "first_seq") else F.col(name)
            for name in columns
        ]
    )


def fold(records: DataFrame, hashed: bool = False) -> DataFrame:
    """One record per content hash; rows without a hash stay as they are.

    ``hashed`` says that every row has a hash, which saves the second pass over
    the input that looks for rows without one.
    """
    keyed = records if hashed else records.filter(F.col("content_hash").isNotNull())
    rows = one_row_per_tag(keyed)
    merged = merged_rows(rows.groupBy("content_hash").agg(*merge_columns(rows)), records.columns)
    if hashed:
        return merged
    return merged.unionByName(records.filter(F.col("content_hash").isNull()))


def update(base: DataFrame, delta: DataFrame) -> DataFrame:
    """``base`` after ``delta``; either has one row per hash. Only the hashes of ``base`` are read twice.

    Spark broadcasts ``delta`` while it is small, and then no row of ``base`` moves.
    """
    def old(name):
        return F.col(name)

    def new(name):
        return F.col(f"__new_{name}")

    joined = base.join(
        delta.select("content_hash", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in delta.columns if c != "content_hash"]),
        "content_hash",
        "left",
    )
    hit = F.coalesce("__hit", F.lit(False))
    newer_first = hit & (F.struct(new("created_at"), new("first_seq")) < F.struct(old("created_at").alias("a"), old("first_seq").alias("b")))
    none = F.array().cast("array<string>")
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce(old("tags"), none), F.coalesce(new("tags"), none))))
    columns = {name: F.when(newer_first, new(name)).otherwise(old(name)) for name in [*FIRST_WRITER, "created_at", "first_seq"] if name in base.columns}
    columns["tags"] = F.when(hit, tags).otherwise(old("tags"))
    columns["confidence"] = F.greatest(old("confidence"), new("confidence"))
    columns["updated_at"] = F.greatest(old("updated_at"), new("updated_at"))
    if "embedding" in base.columns:
        one, two = old("embedding"), new("embedding")
        columns["embedding"] = F.when(newer_first, F.coalesce(two, one)).otherwise(F.coalesce(one, two))
    merged = joined.select("content_hash", *[columns[c].alias(c) for c in base.columns if c != "content_hash"])
    added = delta.join(base.select("content_hash"), "content_hash", "left_anti")
    return merged.select(*base.columns).unionByName(added.select(*base.columns))


def upsert(current: DataFrame, batch: DataFrame, hashed: bool = False) -> DataFrame:
    """``current`` after the writes of ``batch`` (both in record form)."""
    return fold(current.unionByName(batch), hashed)


def append(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``current`` plus the rows of ``batch`` without conflict handling: their hash is left NULL."""
    return current.unionByName(batch.withColumn("content_hash", F.lit(None).cast("binary")))


def touched(merged: DataFrame, batch: DataFrame) -> DataFrame:
    """The merged records that ``batch`` wrote to, without vector and hash."""
    hashes = batch.select("content_hash").distinct()
    return merged.join(hashes, "content_hash", "left_semi").select(
        "id", "type", "content", "source", "tags", "confidence", "created_at", "updated_at"
    )


def duplicate_hashes(records: DataFrame) -> DataFrame:
    """Content hashes held by more than one record; empty for a sound table."""
    return (
        records.filter(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .count()
        .filter(F.col("count") > 1)
    )
