"""Continuous create: a stream of request lines upserted into the memory table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from memspark.operators.embed import Embedder
from memspark.options import Options
from memspark.plans.create import create
from memspark.sources.scratch import Workspace
from memspark.sources.table import MemoryTable


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that writes to a checkpoint folder; it outlives restarts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def ingest_stream(
    lines: DataFrame,
    table: MemoryTable,
    embedder: Embedder,
    checkpoint: str,
    rejects_path: str,
    options: Options = Options(),
    name: str | None = None,
    compact_every: int = 50,
    compact_share: float = 0.1,
    available_now: bool = False,
    **how,
) -> StreamingQuery:
    """Start the stream. Every micro-batch runs the bulk create job.

    The table is the state, so nothing is held in memory between batches. A
    batch that comes again after a restart is recognised by the id that the checkpoint
    gives the stream, and by its number, and is skipped. Its rejects are written before
    the table shows it. Streams with checkpoints of their own never meet, and a fresh
    checkpoint is another stream. ``name`` only names the running query. The table is
    compacted when at least ``compact_every`` batches are pending and they make
    up ``compact_share`` of it, so a large table is seldom rewritten.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        if table.has_batch(stream, batch_id):
            return
        workspace = Workspace(batch.sparkSession)
        try:
            create(
                batch,
                table,
                embedder,
                options,
                stream=stream,
                batch_id=batch_id,
                rejects_path=f"{rejects_path}/stream={stream}/batch={batch_id}",
                workspace=workspace,
                **how,
            )
        finally:
            workspace.clear()
        if table.pending >= compact_every and table.pending_share() >= compact_share:
            table.compact()

    writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    if name is not None:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
