"""Vector expressions: inner product score, normalising, pooling, width check."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions.bind import let

SCORE_DIGITS = 6


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def similarity(a: Column, b: Column) -> Column:
    """One plus the inner product, rounded half up on the binary value; NULL when it is not a finite number.

    ``rounded_scores`` is the same rule for numpy.
    """
    scale = 10.0**SCORE_DIGITS

    def rounded(score: Column) -> Column:
        finite = F.abs(score) < F.lit(float("inf"))  # NaN counts as larger
        return F.when(finite, F.floor(score * scale + 0.5) / scale)

    return let(1.0 + inner_product(a, b), rounded)


def rounded_scores(scores: np.ndarray) -> np.ndarray:
    """Finite scores, rounded half up on the binary value."""
    scale = 10.0**SCORE_DIGITS
    return np.floor(scores * scale + 0.5) / scale + 0.0


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length; the zero vector stays as it is.

    The length is bound first, so it is worked out once per vector and not once
    per element.
    """
    length = F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    divisor = F.when(length > 0, length).otherwise(1.0)
    return let(divisor, lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def _partial_sums(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, sums, counts: one row per key and Arrow batch. A NULL entry, or one beyond the end of a shorter
    vector, counts for nothing at its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__vector")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            width = int(lengths.max(initial=0))
            if not width:
                continue
            flat = column.flatten().cast(pa.float64())
            there = np.arange(width) < lengths[:, None]
            matrix, known = np.zeros(there.shape), np.zeros(there.shape)
            matrix[there] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            known[there] = flat.is_valid().to_numpy(zero_copy_only=False)
            names = [f"k{i}" for i in range(len(keys))]
            table = pa.table(batch.columns[: len(keys)], names).append_column("row", pa.array(np.arange(batch.num_rows)))
            groups = table.group_by(names).aggregate([("row", "list")])
            rows = groups.column("row_list").combine_chunks()
            starts = rows.offsets.to_numpy()[:-1]
            order = rows.flatten().to_numpy()
            sums, counts = (np.add.reduceat(m[order], starts, axis=0) for m in (matrix, known))
            offsets = pa.array(np.arange(0, sums.size + 1, width, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1))) for m in (sums, counts)]
            own = [groups.column(name).combine_chunks() for name in names]
            yield pa.RecordBatch.from_arrays([*own, *lists], [*keys, "__sums", "__counts"])

    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("__sums", numbers), T.StructField("__counts", numbers)])
    return df.select(*keys, F.col(vector).alias("__vector")).mapInArrow(run, schema)


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str, out: str = "embedding") -> DataFrame:
    """Mean vector per key.

    Vectors are added up per key in Arrow batches, then per (key, position), so a
    key that holds most of the rows still sends only one row per position and
    task. The last step gathers exactly one entry per position.
    """
    entries = F.posexplode(F.arrays_zip("__sums", "__counts")).alias("__pos", "__e")
    means = (
        _partial_sums(df, keys, vector)
        .select(*keys, entries)
        .groupBy(*keys, "__pos")
        .agg(F.sum("__e.__sums").alias("__sum"), F.sum("__e.__counts").alias("__n"))
        .filter("__n > 0")
        .withColumn("__mean", F.col("__sum") / F.col("__n"))
    )
    entries = F.sort_array(F.collect_list(F.struct("__pos", "__mean")))
    return means.groupBy(*keys).agg(F.transform(entries, lambda e: e["__mean"]).alias(out))


def width_ok(vector: Column, dim: int) -> Column:
    """True for a vector of exactly ``dim`` numbers, none of them NULL."""
    return F.coalesce(
        (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()), F.lit(False)
    )
