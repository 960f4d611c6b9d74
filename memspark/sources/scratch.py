"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is
    made once and set as the checkpoint folder of the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="memspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """A folder for the intermediate tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/memspark-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.folder}/{label}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` as a table and read it back.

        Used where a costly result feeds more than one job. It cuts the lineage,
        so a lost executor never repeats the work, and later reads prune columns.
        """
        path = self.path(label)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the folder; nothing that reads from it may run afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; needs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
