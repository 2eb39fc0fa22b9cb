"""Suppression of detections that overlap better ones, and agreement of masks by sweeps over runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.functions import geom
from pagegrain.functions.stretch import stretches
from pagegrain.plans.registry import frame, view
from pagegrain.sources.scratch import Stored

BAND = 256


def _edges(dets: DataFrame, least: float) -> DataFrame:
    """better, worse: detections of one group with an IoU of ``least`` or more; pairs meet in bands of rows."""
    b = dets.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))))
    left, right = b.alias("a"), b.alias("b")
    first = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.det_id") < F.col("b.det_id")))
    owner = F.col("a.band") == F.floor(F.greatest("a.y0", "b.y0") / BAND)
    same = (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.band") == F.col("b.band"))
    near = geom.overlaps(geom.box("a."), geom.box("b.")) & (geom.iou(geom.box("a."), geom.box("b.")) >= least)
    return left.join(right, same & first & owner & near).select(F.col("a.group_id").alias("group_id"), F.col("a.det_id").alias("better"), F.col("b.det_id").alias("worse"))


def nms(dets: DataFrame, least: float = 0.3) -> DataFrame:
    """group_id, det_id, kept: from the best score down, a detection is kept if no kept one overlaps it by ``least`` or more.

    ``dets``: group_id, det_id, x0, y0, x1, y1, score; ties: the lesser det_id; null scores count as 0. The order of scores is
    followed by rounds over all groups at once: a detection with no better one left is kept, one with a kept better one goes, and
    both leave the graph. Each round settles the best of every cluster, so rounds end after the longest chain of ever worse
    neighbours; what a round leaves is written down, so that plans stay short. Without a neighbour a detection is kept.
    """
    d = dets.select("group_id", "det_id", "x0", "y0", "x1", "y1", F.coalesce("score", F.lit(0.0)).alias("score"))
    open_ = Stored(_edges(d, least), "nms-edges")
    gone: list[Stored] = []
    while not open_.df.isEmpty():
        e = open_.df
        worse = e.select("group_id", F.col("worse").alias("det_id")).distinct()
        best = e.select("group_id", F.col("better").alias("det_id")).distinct().join(worse, ["group_id", "det_id"], "left_anti")
        out = e.join(best.withColumnRenamed("det_id", "better"), ["group_id", "better"], "left_semi").select("group_id", F.col("worse").alias("det_id")).distinct()
        gone.append(Stored(out, "nms-dropped"))
        out = gone[-1].df
        # an edge ends when its worse side has gone or its better side has
        left = e.join(out.withColumnRenamed("det_id", "worse"), ["group_id", "worse"], "left_anti").join(out.withColumnRenamed("det_id", "better"), ["group_id", "better"], "left_anti")
        after = Stored(left, "nms-edges")
        open_.drop()
        open_ = after
    dropped = d.select("group_id", "det_id").limit(0)
    for g in gone:
        dropped = dropped.union(g.df)
    return d.select("group_id", "det_id").join(dropped.withColumn("gone", F.lit(True)), ["group_id", "det_id"], "left").select("group_id", "det_id", F.col("gone").isNull().alias("kept"))


@view
def detections(d):
    """Three readings of each region, moved by its number, with scores that repeat."""
    return f"""select section_id as group_id, region_id * 3 + k as det_id, x0 + k * (region_id % 4) * 6 as x0, y0 + k * (region_id % 3) * 4 as y0, x1 + k * (region_id % 4) * 6 as x1, y1 + k * (region_id % 3) * 4 as y1,
        ((region_id * 7 + k * 3 + section_id) % 10) / 10e0 as score from regions {d.series('0', '2', 'k')}"""


@frame("E11_nms", "detections")
def e11(dets: DataFrame, least: float = 0.3) -> DataFrame:
    return nms(dets, least)


@view
def mask_runs(d):
    """Runs of rows of three masks: raw (regions), other (the second reading), text (the right third of every second region)."""
    row = d.series("y0", "y1 - 1", "y")
    third = d.floordiv("2 * x1 + x0", "3")
    return f"""select section_id, 'raw' as mask, y, x0, x1 from regions {row} where x1 > x0 union all select section_id, 'other' as mask, y, x0, x1 from regions_b {row} where x1 > x0
        union all select section_id, 'text' as mask, y, {third} as x0, x1 from regions {row} where region_id % 2 = 0 and x1 > {third}"""


@view
def mask_boxes(d):
    """The boxes whose rows are ``mask_runs``."""
    third = d.floordiv("2 * x1 + x0", "3")
    return f"""select section_id, 'raw' as mask, y0, y1, x0, x1 from regions where x1 > x0 union all select section_id, 'other' as mask, y0, y1, x0, x1 from regions_b where x1 > x0
        union all select section_id, 'text' as mask, y0, y1, {third} as x0, x1 from regions where region_id % 2 = 0 and x1 > {third}"""


@view
def mask_steps(d):
    """For each stretch of a row between two ends of runs: its length and how many runs of each mask lie over it.

    The ends of a row's runs are +1 and -1 events; runs of one mask may overlap.
    """
    count = lambda m: f"sum(case when mask = '{m}' then s else 0 end)"
    over = lambda c: f"sum({c}) over (partition by section_id, y order by x rows between unbounded preceding and current row)"
    return f"""select section_id, y, lead(x) over (partition by section_id, y order by x) - x as w, {over('raw')} as raw, {over('other')} as other, {over('text')} as text_ from
        (select section_id, y, x, {count('raw')} as raw, {count('other')} as other, {count('text')} as text from
        (select section_id, mask, y, x0 as x, 1 as s from mask_runs union all select section_id, mask, y, x1 as x, -1 as s from mask_runs) q group by section_id, y, x) z"""


def _m8(d):
    """IoU of two masks outside the text (1 if both are empty there), the share of the first that lies under text, and the flags."""
    area = lambda test: f"coalesce(sum(case when {test} then w else 0 end), 0)"
    return f"""select section_id, {d.bround('iou', 6)} as iou, {d.bround('erased', 4)} as erased_pct, iou < 0.8 as differs, erased > 10 as eats_foreground from
        (select section_id, case when u > 0 then i / cast(u as double) else 1e0 end as iou, case when f > 0 then 100e0 * t / f else 0e0 end as erased from
        (select section_id, {area('raw > 0 and other > 0 and text_ = 0')} as i, {area('(raw > 0 or other > 0) and text_ = 0')} as u, {area('raw > 0')} as f, {area('raw > 0 and text_ > 0')} as t from mask_steps group by section_id) q) z"""


MASKS = ("raw", "other", "text")
#: boxes of a task that are swept at a time, at least
SWEPT = 20_000


def _areas(sec: np.ndarray, mask: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections of boxes in order of section, and four areas of each: both masks and either outside the text, the first, the first under text.

    A section's rows are cut where a box begins or ends; in each stretch of rows the ends of its boxes are swept along x.
    """
    same, at = np.unique(sec, return_inverse=True)
    ends = np.unique(np.stack([np.r_[at, at], np.r_[y0, y1]]), axis=1)
    span = int(ends[1].max() - ends[1].min()) + 1
    place = lambda s, y: s * span + (y - ends[1].min())
    cuts = place(*ends)
    first, last = np.searchsorted(cuts, place(at, y0)), np.searchsorted(cuts, place(at, y1))
    n = np.maximum(last - first, 0)
    box = np.repeat(np.arange(len(sec)), n)
    stretch = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n) + first[box]
    stretch, x = np.r_[stretch, stretch], np.r_[x0[box], x1[box]]
    order = np.lexsort((x, stretch))
    sign, of = np.repeat([1, -1], len(box))[order], np.r_[mask[box], mask[box]][order]
    stretch, x = stretch[order], x[order]
    over = [np.cumsum(np.where(of == k, sign, 0))[:-1] > 0 for k in range(3)]
    inside = stretch[1:] == stretch[:-1]
    area = np.where(inside, x[1:] - x[:-1], 0) * np.where(inside, ends[1][np.minimum(stretch[:-1] + 1, len(cuts) - 1)] - ends[1][stretch[:-1]], 0)
    raw, other, text = over
    out = np.zeros((4, len(same)), np.int64)
    for k, test in enumerate((raw & other & ~text, (raw | other) & ~text, raw, raw & text)):
        np.add.at(out[k], ends[0][stretch[:-1]][test], area[test])
    return same, out


def islands(batches, whole):
    """``whole`` of tables of boxes, each of whole islands: ``SWEPT`` boxes, or one island that has more.

    Boxes have none, section_id, y, y1 and come in order of the first three; no box of a section hangs together with one of another table.
    """
    held: list[pa.RecordBatch] = []
    rows, least = 0, SWEPT
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        none, sec, y0, y1 = (t.column(c).to_numpy() for c in ("none", "section_id", "y", "y1"))
        new = (sec[1:] != sec[:-1]) | (none[1:] != none[:-1])
        # the lowest end so far within a section, by places that rise from one section to the next
        part = np.r_[0, np.cumsum(new)]
        low, span = y0.min(), int(y1.max() - y0.min()) + 1
        far = np.maximum.accumulate(part * span + (y1 - low))
        clean = np.flatnonzero(new | (part[1:] * span + (y0[1:] - low) >= far[:-1])) + 1
        if not len(clean):
            least = 2 * rows
            continue
        yield from whole(t.slice(0, clean[-1]))
        rest = t.slice(clean[-1])
        held, rows, least = rest.to_batches(), rest.num_rows, max(SWEPT, 2 * rest.num_rows)
    if rows:
        yield from whole(pa.Table.from_batches(held))


def mask_areas(masks: DataFrame) -> DataFrame:
    """section_id and areas i, u, f, t of ``_areas`` of three masks given as runs of rows (section_id, mask, y, x0, x1), or as boxes
    (y0 and y1, the row after the last).

    Runs of one width that follow each other become boxes before they are dealt. Boxes of a section come from the top; where none
    crosses a row, what lies above is swept, so a task holds ``SWEPT`` boxes, or one island of boxes that hang together.
    """
    code = F.coalesce(*(F.when(F.col("mask") == m, k) for k, m in enumerate(MASKS)), F.lit(len(MASKS))).cast("tinyint")
    rows = ["y"] if "y" in masks.columns else ["y0", "y1"]
    d = masks.select("section_id", code.alias("mask"), *(F.col(c).cast("bigint").alias(c) for c in ("x0", "x1", *rows))).dropna(subset=["x0", "x1", *rows])
    if rows == ["y"]:
        d = stretches(d, "y", 1).select("section_id", "mask", "x0", "x1", F.col("y").alias("y0"), (F.col("y") + F.col("n")).alias("y1"))
    d = d.where("y1 > y0")
    b = d.select(F.col("section_id").isNull().alias("none"), F.coalesce("section_id", F.lit(0)).cast("bigint").alias("section_id"), "mask", F.col("y0").alias("y"), "y1", "x0", "x1")
    b = b.repartition("none", "section_id").sortWithinPartitions("none", "section_id", "y")

    def swept(t: pa.Table) -> pa.RecordBatch:
        none, sec, mask, y0, y1, x0, x1 = (c.to_numpy() for c in t.columns)
        same, area = _areas(sec, mask, y0, y1, x0, x1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(same), none[0])), pa.array(same), *(pa.array(a) for a in area)], names=["none", "section_id", *"iuft"])

    def run(batches):
        return islands(batches, whole)

    def whole(t: pa.Table):
        none = t.column("none").to_numpy()
        k = int(np.searchsorted(none, True))  # null sections come last
        for part in (t.slice(0, k), t.slice(k)):
            if part.num_rows:
                yield swept(part)

    found = b.mapInArrow(run, "none boolean, section_id bigint, i bigint, u bigint, f bigint, t bigint")
    return found.groupBy(F.when(~F.col("none"), F.col("section_id")).alias("section_id")).agg(*(F.sum(c).alias(c) for c in "iuft"))


#: pairs of boxes that are looked at together, at least those of one id
PAIRED = 1 << 20
_FAR = 1 << 30


def _cover(sec: np.ndarray, ident: np.ndarray, other: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each box that is not ``other``, how much of it lies under the other boxes of its section; boxes of one id share the area.

    0 for other boxes and for all but the first box of an id.
    """
    low, span = int(y0.min()), int(y1.max() - y0.min()) + 2
    part = np.r_[0, np.cumsum(sec[1:] != sec[:-1])]
    top, end = part * span + (y0 - low), part * span + (y1 - low)
    b = np.flatnonzero(other)
    a = np.flatnonzero(~other)
    a = a[np.lexsort((ident[a], part[a]))]
    new = np.append(True, (part[a][1:] != part[a][:-1]) | (ident[a][1:] != ident[a][:-1]))[: len(a)]
    key = np.cumsum(new) - 1
    out = np.zeros(len(sec), np.int64)
    if not len(a) or not len(b):
        return out
    lo = np.searchsorted(np.maximum.accumulate(end[b]), top[a], "right")  # those before end above it
    n = np.maximum(np.searchsorted(top[b], end[a], "left") - lo, 0)
    total = np.r_[0, np.cumsum(n)]
    starts = np.append(np.flatnonzero(new), len(a))
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(total[starts], total[starts[i]] + PAIRED, "right")) - 1)
        p, q = starts[i], starts[j]
        one = np.repeat(np.arange(p, q), n[p:q])
        two = b[np.arange(len(one)) - np.repeat(total[p:q] - total[p], n[p:q]) + lo[one]]
        me = a[one]
        box = np.maximum(y0[me], y0[two]), np.minimum(y1[me], y1[two]), np.maximum(x0[me], x0[two]), np.minimum(x1[me], x1[two])
        ok = (box[0] < box[1]) & (box[2] < box[3]) & (part[me] == part[two]) & (box[2] > -_FAR) & (box[3] < _FAR)
        if ok.any():
            same, area = _areas(key[one[ok]], np.zeros(int(ok.sum()), np.int8), *(c[ok] for c in box))
            out[a[starts[same]]] = area[2]
        i = j
    return out


def covered(regions: DataFrame, others: DataFrame) -> DataFrame:
    """section_id, region_id, cover of every region: the share of its box under the other boxes of its section. Coordinates are whole numbers.

    Boxes of both are shuffled once and pass from the top of a section, island by island; regions of one id share what their boxes have.
    """
    rest = [F.col(c).cast("bigint").alias(c) for c in ("y0", "y1", "x0", "x1")]
    ids = [F.col("section_id").cast("bigint").alias("section_id"), F.col("region_id").cast("bigint").alias("region_id")]
    whole_ = "section_id is not null and region_id is not null and y0 is not null and y1 is not null and y1 > y0"
    size = F.greatest(F.lit(1), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("bigint")
    a = regions.select(*ids, *rest, F.lit(False).alias("other"), size.alias("size"))
    b = others.where(whole_).select(*ids, *rest, F.lit(True).alias("other"), F.lit(1).cast("bigint").alias("size"))
    odd = ~F.coalesce(F.expr(whole_), F.lit(False))
    at = lambda c, none: F.when(odd & (F.lit(c) != "x0") & (F.lit(c) != "x1"), 0).otherwise(F.coalesce(c, F.lit(none))).cast("bigint")
    d = a.union(b).select(
        F.col("section_id").isNull().alias("none"), F.coalesce("section_id", F.lit(0)).alias("section_id"), at("y0", 0).alias("y"), at("y1", 0).alias("y1"), at("x0", -_FAR).alias("x0"), at("x1", _FAR).alias("x1"),
        "region_id", "other", odd.alias("odd"), "size",
    )
    d = d.repartition("none", "section_id").sortWithinPartitions("none", "section_id", "y")

    def whole(t: pa.Table):
        mine = ~t.column("other").to_numpy()
        live = np.flatnonzero(~t.column("odd").to_numpy())
        area = np.zeros(len(mine), np.int64)
        if len(live):
            some = t.take(pa.array(live))
            area[live] = _cover(*(some.column(c).to_numpy() for c in ("section_id", "region_id", "other", "y", "y1", "x0", "x1")))
        found = t.select(["none", "section_id", "region_id", "size"]).append_column("area", pa.array(area)).filter(pa.array(mine))
        yield from found.to_batches()

    found = d.mapInArrow(lambda batches: islands(batches, whole), "none boolean, section_id bigint, region_id bigint, size bigint, area bigint")
    area = F.sum("area").over(W.partitionBy("none", "section_id", "region_id"))
    kinds = {c: regions.schema[c].dataType for c in ("section_id", "region_id")}
    section = F.when(~F.col("none"), F.col("section_id")).cast(kinds["section_id"]).alias("section_id")
    return found.select(section, F.col("region_id").cast(kinds["region_id"]).alias("region_id"), (area / F.col("size").cast("double")).alias("cover"))


@frame("M8_mask_agreement", "mask_runs|mask_boxes", check=_m8)
def m8(masks: DataFrame) -> DataFrame:
    """IoU of two masks outside the text (1 if both are empty there), the share of the first that lies under text, and the flags."""
    iou = F.when(F.col("u") > 0, F.col("i") / F.col("u").cast("double")).otherwise(1.0)
    erased = F.when(F.col("f") > 0, F.lit(100.0) * F.col("t") / F.col("f")).otherwise(0.0)
    d = mask_areas(masks).select("section_id", iou.alias("iou"), erased.alias("erased"))
    return d.select("section_id", F.bround("iou", 6).alias("iou"), F.bround("erased", 4).alias("erased_pct"), (F.col("iou") < 0.8).alias("differs"), (F.col("erased") > 10).alias("eats_foreground"))
