"""Mixing sources to target weights: how many words of each document a mix takes.

A source's target is its weighted share of all words, at most CAP times what it has; what
it cannot take goes to the others by weight. Within a source the documents stand in the order of
a hash of their id. Whole epochs are taken first, then the documents up to the place where
the words counted from the first reach what is left of the target.

The order within a source is cut into ranges of the hash, none of which holds more than about RANGE
documents, so a source with a third of all rows is spread over many tasks. The sum up to a document is
that of the ranges before its own (one row per range) and that of the documents before it in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.sources.scratch import Workspace

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (5, 2, 1)
RANGE = 1000
KEY_BITS = 48


def size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str = "mix") -> Column:
    """48 random bits of an id, the same on every run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source in and out.

    A source is at its cap exactly when cap * size / weight is below the common level of words
    per unit of weight. In the order of that quotient the level follows from running sums
    at the first source that stays below its cap, so nothing is repeated until it settles.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn(
        "weight", F.get(pick, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int"))
    ).withColumn("most", F.col("source_size") * cap)
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn(
        "common",
        F.first(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level")), ignorenulls=True).over(whole),
    )
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("common"), F.lit(0.0)))
    return level.select("source", "source_size", target.alias("target"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (doc_id, source, size, key) with source_size, target, epochs and ``taken``.

    ``sizes`` is read more than once and should be a written table. Source null is a source of its own. Rows
    with the same key stand in the order of id and size; equal rows may change places,
    which leaves the set of result rows as it is. A document without words takes none.
    """
    ranges = max(1, -(-sizes.count() // RANGE))
    keyed = sizes.select(
        "*",
        F.coalesce("source", F.lit("")).alias("source_at"),
        F.col("source").isNull().alias("source_null"),
        F.floor(F.col("key") / F.lit(-(-(1 << KEY_BITS) // ranges))).alias("part"),
    )
    source, group = ["source_at", "source_null"], ["source_at", "source_null", "part"]
    parts = keyed.groupBy(*group).agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy(*source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    parts = parts.select(*group, F.coalesce(F.sum("part_size").over(earlier), none).alias("parts_before"))
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = keyed.withColumn("in_part", F.coalesce(F.sum("size").over(inside), none))
    before = F.col("parts_before") + F.col("in_part")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per_source, weights, cap).select(
        F.coalesce("source", F.lit("")).alias("source_at"), F.col("source").isNull().alias("source_null"), "source_size", "target"
    )
    placed = ordered.join(parts, group).withColumn("before", before).join(plan, source)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before")))
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .withColumn("taken", F.col("epochs") * F.col("size") + part)
        .select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "taken")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of documents."""
    return docs.select("doc_id", "source", size(F.col("text")).alias("size"), order_key(F.col("doc_id")).alias("key"))


def mixed_documents(
    docs: DataFrame, space: Workspace, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """The rows of a mix, with the columns of ``docs``: each document as often as it is taken.

    Documents are whole: the one that the cut divides is taken if half of it or more lies before the cut, and
    none more than ``cap`` times. The cut of a source is a key, so rows that share a doc_id are
    taken alike. Texts without words (null and empty ones too) are not taken. Texts are not shuffled
    unless there are too many sources to broadcast one row for each.
    """
    mixed = mix(space.stage(document_sizes(docs), "sizes"), weights, cap)
    half = (F.col("size") > 0) & (2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size"))
    cuts = mixed.groupBy("source").agg(F.max("epochs").alias("__epochs"), F.max(F.when(half, F.col("key"))).alias("__cut"))
    cuts = space.stage(cuts.withColumnRenamed("source", "__source"), "cuts")
    before_cut = F.coalesce(order_key(F.col("doc_id")) <= F.col("__cut"), F.lit(False)).cast("int")
    rows = docs.filter(F.rlike("text", F.lit(WORD))).join(cuts, F.col("source").eqNullSafe(F.col("__source")))
    times = F.array_repeat(F.lit(0), (F.col("__epochs") + before_cut).cast("int"))
    return rows.withColumn("__copy", F.explode(times)).select(*[rows[c] for c in docs.columns])
