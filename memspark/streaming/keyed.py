"""Upsert as keyed state with one entry per tag, and folding of the changes it writes.

The streaming aggregate of ``dedupe`` rewrites the whole tag set of a record whenever one more write of it comes. Here
the state of a content hash is a value (first writer, confidence, times) and a map with an entry for each tag: a resend writes
the entries of its new tags and the value only if it changed, and nothing is given out for a resend that changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memspark.operators.merge import FIRST_WRITER

# Tags of a record in one batch that are asked for one by one; for more, the stored ones are read once.
FEW_TAGS = 32
_TIMES = ["created_at", "first_seq", "confidence", "updated_at"]


class KeyedMerge(StatefulProcessor):
    """Merges the writes of one content hash; gives the record out when it changed."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.fields = [name for name in FIRST_WRITER if name in schema.names]
        self.value_schema = T.StructType([schema[name] for name in [*self.fields, *_TIMES]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", self.value_schema)
        self.tags = handle.getMapState("tags", T.StructType([T.StructField("tag", T.StringType())]), T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.value.get() if self.value.exists() else None
        now = dict(zip(self.value_schema.names, before)) if before is not None else None
        changed, asked = False, set()
        for row in rows:
            if now is None:
                now, changed = {name: row[name] for name in self.value_schema.names}, True
            else:
                if (row["created_at"], row["first_seq"]) < (now["created_at"], now["first_seq"]):
                    now.update({name: row[name] for name in [*self.fields, "created_at", "first_seq"]})
                    changed = True
                for name in ("confidence", "updated_at"):
                    if now[name] is None or (row[name] is not None and row[name] > now[name]):
                        changed |= now[name] != row[name]
                        now[name] = row[name]
            asked.update(row["tags"] or [])
        # One question costs a round trip to the state store, and the keys come many at a time.
        stored = None
        if before is None:
            stored = set()
        elif len(asked) > FEW_TAGS:
            stored = {tag for (tag,) in self.tags.keys()}
        fresh = asked - stored if stored is not None else {tag for tag in asked if not self.tags.containsKey((tag,))}
        for tag in fresh:
            self.tags.updateValue((tag,), (True,))
        if changed:
            self.value.update(tuple(now[name] for name in self.value_schema.names))
        if changed or fresh:
            tags = sorted(stored | fresh if stored is not None else (tag for (tag,) in self.tags.keys()))
            full = {**now, "content_hash": key[0], "tags": tags}
            yield Row(**{name: full[name] for name in self.schema.names})

    def close(self) -> None:
        pass


def keyed_fold(records: DataFrame) -> DataFrame:
    """The merge of a stream of records (every row with its hash, no vectors), as changes of records.

    There is no watermark, as in ``stream_fold``: a duplicate must merge however late it comes. The state store must be RocksDB.
    """
    names = [name for name in records.columns if name not in ("embedding", "lexemes")]
    times = {name: records.schema[name].dataType for name in ("created_at", "updated_at")}
    # times travel as numbers, which compare alike in state and input
    rows = records.select(names).withColumns({name: F.unix_micros(F.col(name).cast("timestamp")) for name in times})
    merged = rows.groupBy("content_hash").transformWithState(
        KeyedMerge(rows.schema), outputStructType=rows.schema, outputMode="Update", timeMode="None"
    )
    return merged.withColumns({name: F.timestamp_micros(name).cast(kind) for name, kind in times.items()})


def fold_changes(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Fold all but the last ``keep`` change batches of ``path`` into one folder, so that readers open a bounded number.

    Folders are ``batch=N`` and ``folded=N``, which holds the last change of every hash up to and with batch N. What was folded is
    deleted once the new folder is whole; a reader that began before may have to begin again. Returns the number of batches folded.
    """
    numbers, folded = change_folders(spark, path)
    base = max(folded, default=-1)
    old = [n for n in numbers if base < n <= max(numbers) - keep] if numbers else []
    if old:
        last_changes(spark, path, upto=max(old)).write.mode("overwrite").parquet(f"{path}/folded={max(old)}")
        base = max(old)
    files, folder = _files(spark, path)
    for kind, found in (("batch", numbers), ("folded", folded)):
        for n in found:
            if n < base or (kind == "batch" and n == base):
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{kind}={n}"), True)
    return len(old)


def last_changes(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The current record of every hash: its last change after the newest fold, else as it was folded."""
    numbers, folded = change_folders(spark, path)
    base = max(folded, default=-1)
    parts = [(f"{path}/folded={base}", base)] if folded else []
    parts += [(f"{path}/batch={n}", n) for n in numbers if n > base and (upto is None or n <= upto)]
    if not parts:
        raise FileNotFoundError(f"no changes at {path}")
    changes = None
    for folder, number in parts:
        rows = spark.read.parquet(folder).withColumn("__batch", F.lit(number))
        changes = rows if changes is None else changes.unionByName(rows)
    fields = [name for name in changes.columns if name not in ("content_hash", "__batch")]
    newest = F.max_by(F.struct(*fields), "__batch").alias("__last")
    return changes.groupBy("content_hash").agg(newest).select("content_hash", "__last.*")


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def change_folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """The numbers of the whole change batches and folds below ``path``."""
    files, folder = _files(spark, path)
    found: dict[str, list[int]] = {"batch": [], "folded": []}
    if files.exists(folder):
        for status in files.listStatus(folder):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    return sorted(found["batch"]), sorted(found["folded"])
