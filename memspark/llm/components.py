"""Connected components of links, by joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.sources.scratch import Workspace


SMALL = 200_000  # links that one task works on by itself; a round of shuffles would take longer than the work


def _both_ways(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(ways))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round: every node joins its larger neighbours, then its smaller ones, to the
    smallest node it knows. Minima combine before the shuffle, and a node with very many
    neighbours is a skewed key of a plain join, which Spark splits. ``small`` edges stay in one partition, so nothing is shuffled."""
    edges = edges.coalesce(1) if small else edges
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = ways.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.filter(F.col("u") > F.col("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    smaller = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    smaller = smaller.coalesce(1) if small else smaller
    return smaller.filter(F.col("u") > F.col("v")).distinct()


def components(space: Workspace, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of ``links`` that is not the smallest of its component;
    ``label`` is that smallest node. Each round is written to the shared folder."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v"))
    edges = space.stage(edges.distinct(), "edges")
    small, before = edges.count() <= SMALL, None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.coalesce(1) if small else labels
        edges, before = space.stage(_stars(edges, small), "edges"), now
