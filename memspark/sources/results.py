"""Result rows as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# NULL fields are written, and times look like 2024-01-01T00:00:00.000Z.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}


def as_json(df: DataFrame, *columns: str) -> Column:
    """One JSON object per row."""
    return F.to_json(F.struct(*(columns or df.columns)), JSON_OPTIONS)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(as_json(df).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.options(**JSON_OPTIONS).mode(mode).json(path)
