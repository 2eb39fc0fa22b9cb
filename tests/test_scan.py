"""Bucketed windows against plain ones, with null keys and null order values."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.functions import scan


def rows(spark):
    data = [(k, y, i) for i, (k, y) in enumerate((k, y) for k in ("a", None) for y in (0, 1, 5, 9, 9, None))]
    return spark.createDataFrame(data, "k string, y int, id int")


def test_running_and_rank_keep_null_keys(spark):
    df = rows(spark)
    w = W.partitionBy("k").orderBy("y", "id")
    bucket = F.floor(F.coalesce("y", F.lit(-1)) / 4)
    got = scan.running(df, ["k"], ["y", "id"], bucket, F.col("id"), "s").select("id", "s").collect()
    want = df.select("id", F.sum("id").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s")).collect()
    assert sorted(got) == sorted(want) and len(got) == 12
    got = scan.rank_in(df, ["k"], ["y", "id"], bucket, "r").select("id", "r").collect()
    assert sorted(got) == sorted(df.select("id", F.row_number().over(w).cast("bigint").alias("r")).collect())


def test_islands_of_equal_and_touching_intervals(spark):
    df = spark.createDataFrame([(None, 0, 10), (None, 0, 10), (None, 10, 20), (None, 21, 30)], "k string, s int, e int")
    for _ in range(5):
        got = scan.islands(df, ["k"], F.col("s"), F.col("e"), 8, "i").select("s", "i").collect()
        assert sorted(map(tuple, got)) == [(0, 0), (0, 0), (10, 0), (21, 21)]
