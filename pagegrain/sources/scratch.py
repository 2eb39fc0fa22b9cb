"""Where intermediate tables go.

A cluster names a folder that driver and executors share in ``spark.checkpoint.dir``.
Only a single-process session (``local`` / ``local[n]``, as in tests) that has none
gets a temporary folder; any other session without the setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get(KEY, None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(KEY, root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Stored:
    """A written table: ``df`` reads it, ``drop`` deletes its files once nothing reads them."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives lost executors."""
    return Stored(df, name).df
