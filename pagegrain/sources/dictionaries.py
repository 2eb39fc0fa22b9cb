"""Dictionaries kept as files by name: ``root/name.jsonl``, ``.csv`` or ``.parquet`` (a file or a folder of that name)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 10_000
KINDS = ("parquet", "jsonl", "csv")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_dict(spark: SparkSession, root: str, name: str, key: Sequence[str] = (), most: int = ROWS) -> DataFrame:
    """The dictionary ``name``, marked for a broadcast join: its rows are counted first, and more than ``most`` are an error.

    Rows with a null in ``key`` go; a key on several rows is an error, since a join would repeat the caller's rows.
    CSV files have a header and strings only. A name that no file has is an error, one with two kinds of files as well.
    """
    found = [kind for kind in KINDS if _there(spark, f"{root}/{name}.{kind}")]
    if len(found) != 1:
        raise ValueError(f"dictionary {name}: {'no file' if not found else 'files of several kinds'} in {root}")
    path, kind = f"{root}/{name}.{found[0]}", found[0]
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.json(path) if kind == "jsonl" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"dictionary {name} has more than {most} rows")
    if key and rows.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"dictionary {name}: {', '.join(key)} is not unique")
    return F.broadcast(rows)
