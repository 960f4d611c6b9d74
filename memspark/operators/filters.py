"""Type and tag filters of search and list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """At least one tag in common. ``arrays_overlap`` gives NULL next to a NULL tag; that counts as no."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def matching(memories: DataFrame, type: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """Rows that pass every given filter; an empty type or tag list filters nothing."""
    if type:
        memories = memories.filter(F.col("type") == type)
    if tags:
        memories = memories.filter(has_any_tag(F.col("tags"), tags))
    return memories
