"""Tables that an operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local session without the setting gets a temporary one, gone at exit."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and spark.sparkContext.master.partition("[")[0] == "local":
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="hydroframe-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = f"file://{_local[0]}"
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written and read back, so that lineage ends there; each is dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.held: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, self.name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete these tables, or all if none are named."""
        for out, path in list(self.held):
            if not frames or any(out is f for f in frames):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
                self.held = [h for h in self.held if h[1] != path]

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these, which a result still reads."""
        spent = [out for out, _ in self.held if not any(out is f for f in frames)]
        if spent:
            self.drop(*spent)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the shared folder and read back."""
    return Scratch(df.sparkSession, "cut").write(df)
