"""Equi-join of rows with a unique lookup table when a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than one part in HOT_PARTS of all rows, so
# there are always fewer than HOT_PARTS hot keys: a safe size to broadcast.
HOT_PARTS = 1000

# Bytes of joined rows that the rows of one key and salt make, about, in ``join_sized``.
PART_BYTES = 256 << 20
# Such parts at most: beyond, they grow.
SIZED_PARTS = 10_000
# What a row takes besides its long fields, about.
ROW_BYTES = 200


def join_salted(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    counts: DataFrame,
    spread_by: list[str],
    how: str = "left",
) -> DataFrame:
    """``rows`` joined with ``lookup``; hot keys are spread over many tasks.

    ``counts`` gives (key, n), the number of rows per key. The lookup row of a
    hot key is copied once per salt, and its rows take a salt from a hash of
    ``spread_by`` (columns that identify a row, so a retried task repeats it).
    No key keeps more than about one part in HOT_PARTS of the rows together, and
    at most 2 * HOT_PARTS lookup rows are added.
    """
    total = counts.agg(F.sum("n")).scalar()
    salts = F.ceil(F.col("n") * HOT_PARTS / total).cast("int")
    hot = counts.select(key, salts.alias("__salts")).filter(F.col("__salts") > 1)
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("__salts", F.lit(1))).cast("int")
    )
    salted_lookup = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    return salted_rows.drop("__salts").join(salted_lookup.drop("__salts"), [key, "__salt"], how).drop("__salt")


def join_sized(rows: DataFrame, lookup: DataFrame, key: str, sizes: DataFrame, spread_by: list[str]) -> DataFrame:
    """``rows`` left joined with ``lookup``, whose rows may be very long, dealt by the size of the result.

    ``sizes`` gives (key, n, bytes): the rows of a key and the bytes of its lookup rows, 0 where there is none. It is read
    several times. Joined rows may be a thousand times as long as what the join reads, and whoever writes them holds some
    of a task's rows. So a key is spread when its joined rows take more than PART_BYTES, and the number of tasks goes by
    the bytes of all joined rows. It is given, as Spark would merge tasks by the bytes they read.
    """
    weight = F.col("n") * (F.col("bytes") + ROW_BYTES)
    total = sizes.agg(F.sum(weight).alias("total")).first()["total"] or 0
    part = max(PART_BYTES, total // SIZED_PARTS)
    # twice as many tasks as parts, since a hash does not deal evenly; small results still go to all cores
    tasks = max(1, -(-2 * total // part), min(total // (PART_BYTES // 32), rows.sparkSession.sparkContext.defaultParallelism))
    hot = sizes.select(key, F.ceil(weight / part).cast("int").alias("__salts")).filter(F.col("__salts") > 1)
    salted_rows = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("__salts", F.lit(1))).cast("int")
    )
    salted_lookup = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    dealt = [side.drop("__salts").repartition(int(tasks), key, "__salt") for side in (salted_rows, salted_lookup)]
    return dealt[0].join(dealt[1], [key, "__salt"], "left").drop("__salt")
