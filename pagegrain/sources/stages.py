"""Results of stages on disk: written by variant, in whole or in part, and read by folder.

A stage's rows lie under ``rows/stage=/variant=/unit_part=``; figures of a whole run under
``metrics/stage=/variant=``. A partial run replaces only the parts its units lie in, each as old rows of
other units plus its own, and leaves the figures alone. Files appear when a job commits, so a run
that dies half way leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.sources.scratch import Stored

PARTS = 32


def _part(unit: str) -> Column:
    return F.pmod(F.xxhash64(F.col(unit).cast("string")), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_stage(spark: SparkSession, root: str, stage: str, variant: str | None = None) -> DataFrame:
    """Rows of a stage, all variants or one."""
    d = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows/stage={stage}")
    d = d.withColumn("variant", F.col("variant").cast("string")).drop("unit_part", "stage")
    return d if variant is None else d.where(F.col("variant") == variant)


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """A row for each stage and variant that had a whole run."""
    return spark.read.parquet(f"{root}/metrics")


def write_stage(df: DataFrame, root: str, stage: str, variant: str, unit: str = "section_id", partial: bool = False) -> None:
    """Write the rows of a variant; ``unit`` names the column of the thing that a run works on.

    A whole run replaces all of the variant's rows and its figures (units, rows). A partial one replaces the rows of the units that
    it has; what is new goes to the scratch folder first, as the parts it replaces are read for it. Other variants stay.
    Null units are a unit like any other. The columns must be those already there.
    """
    if {"stage", "variant", "unit_part"} & set(df.columns):
        raise ValueError("stage, variant and unit_part are names of folders")
    spark, at = df.sparkSession, f"{root}/rows"
    named = lambda d: d.withColumns({"unit_part": _part(unit), "stage": F.lit(stage), "variant": F.lit(variant)})
    here = f"{at}/stage={stage}/variant={variant}"
    if partial and _exists(spark, here):
        mine = Stored(df, "partial")
        parts = named(mine.df).select("unit_part").distinct()
        old = spark.read.parquet(here)
        old = old.join(F.broadcast(parts), "unit_part", "left_semi")  # at most PARTS rows
        same = F.col(f"_old.{unit}").eqNullSafe(F.col(f"_new.{unit}"))
        kept = old.alias("_old").join(mine.df.select(unit).distinct().alias("_new"), same, "left_anti").select(*mine.df.columns)
        whole = Stored(kept.union(mine.df), "parts")
        _put(named(whole.df), at, "stage", "variant", "unit_part")
        mine.drop(), whole.drop()
        return
    out = Stored(df, "stage")
    every = named(out.df)
    if _exists(spark, here):
        # parts that have no rows any more would stay under a dynamic overwrite
        used = {r.unit_part for r in every.select("unit_part").distinct().collect()}
        _put(every, at, "stage", "variant", "unit_part")
        for k in set(range(PARTS)) - used:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{here}/unit_part={k}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    else:
        _put(every, at, "stage", "variant", "unit_part")
    if not partial:
        figures = out.df.agg(F.count_distinct(F.coalesce(F.col(unit).cast("string"), F.lit(""))).alias("units"), F.count(F.lit(1)).alias("n_rows"))
        _put(figures.withColumns({"stage": F.lit(stage), "variant": F.lit(variant)}), f"{root}/metrics", "stage", "variant")
    out.drop()


ANSWER = "doc_id string, parse_error string, translations array<struct<id:string,translation:string,note:string>>, _broken string"


def read_translations(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """label, file, id, translation, note, parse_failed of the JSON files of result folders under ``root``.

    A folder at depth 1 that has JSON files itself is a result and its name the label; else each folder at depth 2 that has some is
    one, labelled ``first/second``. Deeper files belong to none. A file is one object with ``translations``; one without
    any, or that is no JSON, gives a row without id. With ``lines`` a file has an object on each line. A later file's answer to the same id stays beside the earlier one's.
    """
    files = spark.read.format("text").option("wholetext", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("value", F.col("_metadata.file_path").alias("path"))
    plain = lambda x: F.regexp_replace(x, "^[a-z]+:/+", "/")
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    inner = F.substring(plain(F.url_decode(F.regexp_replace("path", r"\+", "%2B"))), len(base) + 2, 1 << 20)
    steps = F.split(inner, "/")
    d = files.select("value", inner.alias("file"), steps.alias("steps")).where(F.size("steps").between(2, 3)).withColumn("top", F.get("steps", F.lit(0)))
    flat = d.where(F.size("steps") == 2).select("top").distinct().withColumn("flat", F.lit(True))
    # a folder may hold all rows: they stay where they are, and the names of folders (a row each) go to them
    d = d.join(F.broadcast(flat), "top", "left").where((F.size("steps") == 2) | F.col("flat").isNull())
    label = F.when(F.size("steps") == 2, F.col("top")).otherwise(F.concat_ws("/", "top", F.get("steps", F.lit(1))))
    d = d.select(label.alias("label"), "file", F.from_json("value", ANSWER, {"columnNameOfCorruptRecord": "_broken"}).alias("j"))
    failed = F.col("j").isNull() | F.col("j._broken").isNotNull() | F.coalesce(~F.col("j.parse_error").isin("", "false", "0"), F.lit(False))
    d = d.select("label", "file", failed.alias("parse_failed"), F.explode_outer("j.translations").alias("t"))
    return d.select("label", "file", F.col("t.id").alias("id"), F.col("t.translation").alias("translation"), F.col("t.note").alias("note"), "parse_failed")
