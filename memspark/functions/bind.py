"""A value that is worked out once and used many times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``.

    Naming a column does not give this: the optimizer may copy the expression
    behind a name into every place that uses it, loops included. The variable
    of a loop over one element is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
