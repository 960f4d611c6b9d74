"""Chat formatting: collapse logged snapshots of growing conversations, render what is left.

A log may hold a conversation many times, each time a few turns longer. Turns get a hash of
place, role and text; the exclusive-or of the hashes up to a turn is the rolling hash of the
prefix that ends there. A conversation whose last prefix hash is an inner prefix hash of another one
is a snapshot and goes; of equal conversations the smallest id stays. What stays is rendered.

Only hashes are shuffled to find the snapshots. Prefixes are made distinct before the anti-join, with a
partial step in each task, so a first turn that very many conversations share is one row there.
Texts are shuffled once, and only for conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with the texts that are compared: null role or text reads as empty. Rows without
    conversation id are left out, as they belong to no conversation."""
    return conversations.filter("conv_id is not null").select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, turns): rolling hashes of every prefix, 128 bits together.

    Turns stand in the order of turn number, then role and text (by hash); repeated rows are one turn.
    """
    turns = _turns(conversations)
    hashed = turns.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(7), "role").alias("b"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.distinct().withColumn("place", F.row_number().over(by_turn))
    tagged = placed.withColumn("x", F.xxhash64("place", "a", "b")).withColumn("y", F.xxhash64("b", "place", "a"))
    return tagged.select(
        "conv_id",
        "place",
        F.bit_xor("x").over(so_far).alias("h1"),
        F.bit_xor("y").over(so_far).alias("h2"),
        F.count("*").over(Window.partitionBy("conv_id")).alias("turns"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, copies) of the conversations that prefix no longer one: the smallest id of equal ones."""
    marked = prefixes(conversations)
    key = ["place", "h1", "h2"]
    whole = (
        marked.filter(F.col("place") == F.col("turns"))
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    )
    inner = marked.filter(F.col("place") < F.col("turns")).select(*key).distinct()
    kept = whole.join(inner, key, "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("turns"), "copies")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def render(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, turns, copies, text) of the kept conversations."""
    turns = _turns(conversations).join(kept, "conv_id")
    order = F.struct("turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(7), "role").alias("b"))
    turns = turns.select("conv_id", "turns", "copies", order.alias("at"), _rendered(F.col("role"), F.col("text")).alias("piece"))
    rows = turns.groupBy("conv_id", "turns", "copies").agg(F.array_sort(F.collect_set(F.struct("at", "piece"))).alias("rows"))
    return rows.select("conv_id", "turns", "copies", F.array_join("rows.piece", "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Maximal conversations in chat markup; an empty table gives no rows."""
    return render(conversations, maximal(conversations))
