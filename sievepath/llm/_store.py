"""Tables written between stages, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is set only where none is (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:
            base = tempfile.mkdtemp(prefix="sievepath-")
            atexit.register(shutil.rmtree, base, True)
            spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


class Scratch:
    """A private folder for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Scratch:
        """The stated folder itself, for what later runs take up."""
        store = cls.__new__(cls)
        store.spark, store.root = spark, folder if ":/" in folder else f"file://{folder}"
        return store

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes the table and returns it as read back, which cuts the lineage."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
