"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which is also made the checkpoint folder; without it, one of our own on a local master alone.

    Raises RuntimeError where executors are elsewhere and the setting is missing:
    a folder of the driver's would be another one on each of them.
    """
    context = spark.sparkContext
    got = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not got:
        if not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(got)
    return got


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Intermediate tables in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.live: dict[str, None] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.live[path] = None
        out = self.spark.read.schema(df.schema).parquet(path)
        out._own_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for x in frames:
            path = x._own_path
            if path in self.live:
                del self.live[path]
                remove(self.spark, path)

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables but these, which the result still reads."""
        kept = {x._own_path for x in frames}
        for path in [p for p in self.live if p not in kept]:
            del self.live[path]
            remove(self.spark, path)
