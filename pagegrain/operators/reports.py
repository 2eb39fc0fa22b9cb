"""Tile plans by mode, verdicts carried between equal variants, and the gate against an earlier run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.plans.registry import frame, view

MODES = ("whole", "bands", "overlap", "square")


def _tops(mode: str, h: Column, w: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """Where tiles begin, and their height."""
    begin = lambda last, step: F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(step).cast("bigint") if isinstance(step, int) else step.cast("bigint"))
    if mode == "whole":
        return F.array(F.lit(0).cast("bigint")), h
    if mode == "bands":
        return begin(h - 1, size), F.lit(size)
    if mode == "overlap":
        return begin(F.greatest(h - overlap, F.lit(1)) - 1, size - overlap), F.lit(size)
    tall = F.array_distinct(F.concat(begin(h - w - 1, F.greatest(F.lit(1), w - overlap)), F.array((h - w).cast("bigint"))))
    return F.when(h <= w, F.array(F.lit(0).cast("bigint"))).otherwise(tall), w


def tile_plan(pages: DataFrame, mode: str = "overlap", size: int = 2000, overlap: int = 300) -> DataFrame:
    """page_id, tile, y0, y1, keep0, keep1 of pages (page_id, h, w): where tiles lie, and whose middle belongs to them.

    whole: one tile; bands: ``size`` high without overlap; overlap: bands that share ``overlap`` rows, which they split between
    them; square: as high as the page is wide, sharing ``overlap`` rows, the last one flush with the end. Pages without height have no tile.
    """
    if mode not in MODES or not 0 <= overlap < size:
        raise ValueError(f"mode is one of {MODES}, and overlap less than size")
    tops, high = _tops(mode, F.col("h"), F.col("w"), size, overlap)
    d = pages.where("h > 0").select("page_id", "h", high.cast("bigint").alias("high"), tops.alias("tops"))
    d = d.select("*", F.size("tops").alias("n"), F.posexplode("tops").alias("tile", "y0")).withColumn("y1", F.least(F.col("h"), F.col("y0") + F.col("high")))
    half = overlap // 2 if mode == "overlap" else 0
    keep0 = F.col("y0") + F.when(F.col("tile") > 0, half).otherwise(0)
    keep1 = F.col("y1") - F.when(F.col("tile") < F.col("n") - 1, half).otherwise(0)
    return d.select("page_id", F.col("tile").cast("bigint").alias("tile"), "y0", "y1", keep0.cast("bigint").alias("keep0"), keep1.cast("bigint").alias("keep1"))


def propagate_verdicts(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """unit_id, variant, verdict, origin: verdicts, and those copied to variants without one whose blocks are the same.

    ``blocks``: unit_id, variant, part (what a block is made of, with its role); ``verdicts``: unit_id, variant, verdict. Variants of a unit
    with the same set of parts form a group. Where all verdicts of a group agree, the others of it get it (origin: the first of
    the variants that has it); where they differ nothing is copied, and every verdict of the group has the origin ``conflict``.
    A unit's own verdict has the origin ``own``.
    """
    # a set as a count and two sums of hashes: combined before the shuffle, whatever a unit's size
    parts = blocks.select("unit_id", "variant", "part").distinct()
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "part").cast("decimal(20,0)"))
    sets = parts.groupBy("unit_id", "variant").agg(F.struct(F.count(F.lit(1)).alias("n"), h(1).alias("a"), h(2).alias("b")).alias("sig"))
    d = sets.join(verdicts.where("verdict is not null"), ["unit_id", "variant"], "left")
    groups = d.groupBy("unit_id", "sig").agg(F.min_by("variant", F.when(F.col("verdict").isNotNull(), F.col("variant"))).alias("first"), F.min("verdict").alias("low"), F.max("verdict").alias("high"))
    d = d.join(groups, ["unit_id", "sig"]).where("low is not null")
    conflict = F.col("low") != F.col("high")
    out = d.where(F.col("verdict").isNotNull() | ~conflict)
    origin = F.when(conflict, "conflict").when(F.col("verdict").isNotNull(), "own").otherwise(F.col("first"))
    return out.select("unit_id", "variant", F.coalesce("verdict", "low").alias("verdict"), origin.alias("origin"))


def gate_vs_prev(states: DataFrame, before: DataFrame) -> DataFrame:
    """key, found, missed, false_, and whether neither missed nor false went up against ``before``.

    Both: key, state (found, missed or false). A key that was not there before passes with nothing missed and nothing false.
    """
    count = lambda d, s="": d.groupBy("key").agg(*(F.count_if(F.col("state") == x).alias(f"{n}{s}") for x, n in (("found", "found"), ("missed", "missed"), ("false", "false_"))))
    d = count(states).join(count(before, "_before"), "key", "left")
    was = lambda c: F.coalesce(f"{c}_before", F.lit(0))
    return d.select("key", "found", "missed", "false_", ((F.col("missed") <= was("missed")) & (F.col("false_") <= was("false_"))).alias("passed"))


@view
def page_sizes(d):
    return "select section_id as page_id, max(y1) as h, max(x1) as w from regions group by section_id"


@view
def unit_parts(d):
    """Blocks of two variants of sections by their text."""
    return f"select section_id as unit_id, 'a' as variant, {d.sha('text')} as part from blocks union all select section_id as unit_id, 'b' as variant, {d.sha('text')} as part from blocks_b"


@view
def verdicts_given(d):
    """Grades: variant a has most of them, and b a few, some of another kind."""
    return """select unit_id, 'a' as variant, grade as verdict from grades where grade <> '-' union all select unit_id, 'b' as variant, case when n_blocks % 2 = 0 then grade else 'C' end as verdict from grades where n_blocks % 5 = 0 and grade <> '-'"""


@view
def states_now(d):
    return """select section_id as key, case when found then 'found' else 'missed' end as state from matched union all
        select b.section_id as key, 'false' as state from regions_b b left join (select distinct section_id, b from matched where found) m on b.section_id = m.section_id and b.region_id = m.b where m.b is null"""


@view
def states_before(d):
    """The same without the wide regions."""
    return "select section_id as key, case when found then 'found' else 'missed' end as state from matched where w <= 400"


@frame("B20_tile_modes", "page_sizes")
def b20(pages: DataFrame, size: int = 200, overlap: int = 60) -> DataFrame:
    """All modes side by side."""
    out = None
    for mode in MODES:
        one = tile_plan(pages, mode, size, overlap).select(F.lit(mode).alias("mode"), "*")
        out = one if out is None else out.union(one)
    return out


@frame("C16_verdicts_with_conflicts", "unit_parts", "verdicts_given")
def c16(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    return propagate_verdicts(blocks, verdicts)


@frame("E8_gate_missed_and_false", "states_now", "states_before", check=lambda d: """with n as (select key, count(*) filter (state = 'found') as found, count(*) filter (state = 'missed') as missed, count(*) filter (state = 'false') as false_ from states_now group by key),
    p as (select key, count(*) filter (state = 'missed') as m, count(*) filter (state = 'false') as f from states_before group by key)
    select n.key, found, missed, false_, missed <= coalesce(m, 0) and false_ <= coalesce(f, 0) as passed from n left join p using (key)""")
def e8(states: DataFrame, before: DataFrame) -> DataFrame:
    return gate_vs_prev(states, before)
