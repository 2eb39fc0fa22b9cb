"""Order statistics with the reference semantics.

All of them are single aggregates that Spark merges map-side: ``percentile_disc``
keeps one counter per distinct value, so a hot group costs memory by its number of
distinct values (pixel heights, rounded ratios), never by its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_quantile(value: str, q: float) -> Column:
    """``sorted(x)[int(n * q)]`` for q in (0, 1) with an exact binary complement.

    Read from the other end: the element with 0-based ascending index floor(n*q) is
    the one with 1-based descending rank ceil(n*(1-q)), which is what
    ``percentile_disc(1-q)`` over the descending order returns.
    """
    return F.expr(f"percentile_disc({1 - q}) WITHIN GROUP (ORDER BY {value} DESC)")


def upper_median(value: str) -> Column:
    """``sorted(x)[n // 2]``: the upper one of the two middle values."""
    return index_quantile(value, 0.5)


def ratio(num: Column, den: Column) -> Column:
    """Null instead of a division by zero."""
    return F.when(den > 0, num / den)
