"""Box arithmetic as column expressions.

A box is four integer columns ``x0, y0, x1, y1``; ``box("a.")`` addresses them under an
alias, ``box("t_")`` with a prefix.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def w(self) -> Column:
        return self.x1 - self.x0

    @property
    def h(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.w.cast("long") * self.h.cast("long")

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / F.lit(2)

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / F.lit(2)


def box(prefix: str = "") -> Box:
    """Columns of a box; ``prefix`` is put in front of each name (``'a.'``, ``'t_'``)."""
    return Box(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))


def _span(lo_a, hi_a, lo_b, hi_b) -> Column:
    return F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def v_overlap(a: Box, b: Box) -> Column:
    """Shared height over the smaller height."""
    return _span(a.y0, a.y1, b.y0, b.y1) / F.greatest(F.lit(1), F.least(a.h, b.h))


def h_overlap(a: Box, b: Box) -> Column:
    """Shared width over the smaller width."""
    return _span(a.x0, a.x1, b.x0, b.x1) / F.greatest(F.lit(1), F.least(a.w, b.w))


def inter_area(a: Box, b: Box) -> Column:
    return _span(a.x0, a.x1, b.x0, b.x1).cast("long") * _span(a.y0, a.y1, b.y0, b.y1).cast("long")


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 where the union is empty."""
    inter = inter_area(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def contains(outer: Box, inner: Box, tol: int = 6) -> Column:
    """``inner`` lies in ``outer`` up to ``tol`` pixels."""
    return (
        (inner.x0 >= outer.x0 - tol)
        & (inner.y0 >= outer.y0 - tol)
        & (inner.x1 <= outer.x1 + tol)
        & (inner.y1 <= outer.y1 + tol)
    )


def center_in(inner: Box, outer: Box) -> Column:
    """Centre of ``inner`` lies in ``outer``, borders included."""
    return inner.cx.between(outer.x0, outer.x1) & inner.cy.between(outer.y0, outer.y1)


def overlaps(a: Box, b: Box) -> Column:
    """The boxes share more than a border."""
    return (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (
        F.least(a.y1, b.y1) > F.greatest(a.y0, b.y0)
    )
