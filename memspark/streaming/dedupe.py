"""Upsert as streaming state: one merged record per content hash, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.operators.merge import merge_columns, merged_rows, one_row_per_tag

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def stream_fold(records: DataFrame) -> DataFrame:
    """The merge of a stream of records, every row with its hash.

    There is no watermark: a duplicate must merge however late it comes, so the
    state grows with the number of distinct hashes. The aggregate is the one of
    the batch job.
    """
    rows = one_row_per_tag(records)
    return merged_rows(rows.groupBy("content_hash").agg(*merge_columns(rows)), records.columns)


def write_changes(
    merged: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Write the changed records of every micro-batch to ``path/batch=N``.

    A batch that runs twice writes the same folder twice. The state is kept in
    RocksDB, on disk, unless the session names another store.
    """
    session = merged.sparkSession
    if session.conf.get(PROVIDER) == DEFAULT:
        session.conf.set(PROVIDER, ROCKSDB)

    def write(changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = merged.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The current record of every hash: the one of its last change."""
    changes = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    fields = [name for name in changes.columns if name not in ("content_hash", "batch")]
    newest = F.max_by(F.struct(*fields), "batch")
    return changes.groupBy("content_hash").agg(newest.alias("__last")).select("content_hash", "__last.*")
