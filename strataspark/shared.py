"""Written intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach: what ``spark.checkpoint.dir`` names.

    A local session (tests) without that setting gets a folder of its own; on a cluster
    the setting must be there, as a machine-local folder would lose rows.
    """
    found = spark.conf.get(FOLDER, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{FOLDER} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strataspark-")
        spark.conf.set(FOLDER, found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder on any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written once and read back, which cuts their lineage; as a context manager it
    deletes them at its end, when what reads them has been written or collected."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str = "scratch") -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def drop(self) -> int:
        """Delete the tables; how many there were."""
        n = len(self.paths)
        for path in self.paths:
            drop(self.spark, path)
        self.paths.clear()
        return n
