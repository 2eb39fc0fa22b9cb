"""Running values over long ordered keys without giving one task a whole key.

A plain ``Window.partitionBy(page)`` puts every row of a page into one task. The
helpers here cut each key into *buckets* that follow the sort order (for example
``floor(y0 / 4096)``), run the window inside each (key, bucket), and carry the totals
of earlier buckets in from a second window that sees one row per bucket.
The result is the same as the plain window; the widest task holds one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _add(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.greatest if how == "max" else F.least)(a, b)


def _with_carry(local: DataFrame, carry: DataFrame, part: list[str]) -> DataFrame:
    """Join on the parts of a key; null is a part like any other."""
    carry = carry.select(*(F.col(c).alias(f"_of_{i}") for i, c in enumerate(part)), *(c for c in carry.columns if c not in part))
    same = [local[c].eqNullSafe(carry[f"_of_{i}"]) for i, c in enumerate(part)]
    return local.join(carry, same, "inner").drop(*(f"_of_{i}" for i in range(len(part))))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    value: Column,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Prefix ``how`` of ``value`` per ``keys`` in ``order``. ``bucket`` must not
    decrease along ``order``. Sums start at 0, max/min at null."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    part = [*keys, "_bucket"]
    local_w = W.partitionBy(*part).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    local = df.withColumn("_local", _AGG[how]("_value").over(local_w))
    totals = local.groupBy(*part).agg(_AGG[how]("_value").alias("_total"))
    carry_w = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*part, _AGG[how]("_total").over(carry_w).alias("_carry"))
    return (
        _with_carry(local, carry, part)
        .withColumn(out, _add(how, F.col("_local"), F.col("_carry")))
        .drop("_bucket", "_value", "_local", "_carry")
    )


def rank_in(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column,
    out: str,
    start: int = 1,
) -> DataFrame:
    """``row_number`` per ``keys`` in ``order``, counted from ``start``."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
    totals = local.groupBy(*part).agg(F.count(F.lit(1)).alias("_total"))
    carry_w = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *part, F.coalesce(F.sum("_total").over(carry_w), F.lit(0)).alias("_carry")
    )
    rank = (F.col("_local") + F.col("_carry") + F.lit(start - 1)).cast("bigint")
    return _with_carry(local, carry, part).withColumn(out, rank).drop("_bucket", "_local", "_carry")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    fields: Sequence[str],
    before: str | None = "prev_",
    after: str | None = "next_",
) -> DataFrame:
    """``lag`` / ``lead`` of ``fields`` per ``keys`` along the unique column ``order``."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    part = [*keys, "_bucket"]
    local_w = W.partitionBy(*part).orderBy(order)
    row = F.struct(F.col(order), *(F.col(f) for f in fields if f != order))
    local = (
        df.withColumn("_row", row)
        .withColumn("_lag", F.lag("_row").over(local_w))
        .withColumn("_lead", F.lead("_row").over(local_w))
    )
    ends = local.groupBy(*part).agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    carry_w = W.partitionBy(*keys).orderBy("_bucket")
    ends = ends.select(
        *part,
        F.lag("_last").over(carry_w).alias("_before"),
        F.lead("_first").over(carry_w).alias("_after"),
    )
    res = _with_carry(local, ends, part)
    for f in fields:
        if before is not None:
            res = res.withColumn(before + f, F.coalesce(F.col("_lag"), F.col("_before"))[f])
        if after is not None:
            res = res.withColumn(after + f, F.coalesce(F.col("_lead"), F.col("_after"))[f])
    return res.drop("_bucket", "_row", "_lag", "_lead", "_before", "_after")


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: Column,
    end: Column,
    bucket_width: int,
    out: str,
) -> DataFrame:
    """Connected groups of intervals per key, named by their start; touching ones connect.

    Intervals of different islands share no point, so any algorithm that only lets
    overlapping items interact gives the same answer run island by island.
    """
    df = df.withColumn("_s", start).withColumn("_e", end)
    bucket = F.floor(F.col("_s") / bucket_width)
    df = running(df, keys, ["_s", "_e"], bucket, F.col("_e"), "_reach", "max", inclusive=False)
    # of intervals with one start the one that opens an island goes first, whatever their ends
    opens = F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), F.col("_s"))
    df = df.withColumn("_opens", opens)
    df = running(df, keys, ["_s", F.col("_opens").desc_nulls_last()], bucket, F.col("_opens"), out, "max")
    return df.drop("_s", "_e", "_reach", "_opens")
