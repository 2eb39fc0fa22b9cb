"""Regions to lines, lines to paragraphs, and what stands on them: blocks, units, rows of boxes.

Both merges are greedy: an item joins the first open group whose last member it fits. Items of
different islands never fit, so both folds run island by island: the boxes of a section come
from the top, once, and a task holds those of one island of paragraphs. Islands follow each
other down the section, so lines and blocks get their numbers on the way, and blocks, units and rows of
boxes leave the same pass. Boxes (with text where it is wanted) are written once, dealt by section once for the
gutters (two columns) and once for the fold; nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from math import ceil
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.fold import fold
from pagegrain.plans.registry import frame
from pagegrain.sources.scratch import materialize

BOX = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Merge:
    """Largest gap between neighbours of a line and of a paragraph in heights, largest ratio of heights,
    least share of width that lines of a paragraph have in common, and whether lines stop at gutters."""

    line_gap: float = 0.7
    para_gap: float = 0.6
    h_ratio: float = 1.5
    overlap: float = 0.5
    gutter: bool = True


def _share(lo_a, hi_a, lo_b, hi_b) -> float:
    return max(0, min(hi_a, hi_b) - max(lo_a, lo_b)) / max(1, min(hi_a - lo_a, hi_b - lo_b))


class Line(NamedTuple):
    """A line: its first region, its number in the section, box, greatest height, the place of its first region, and its
    members (region_id, x0, y0, x1, y1, text)."""

    name: int
    no: int
    x0: int
    y0: int
    x1: int
    y1: int
    h: int
    first_y0: int
    first_x0: int
    members: list[tuple] = []

    @property
    def text(self) -> str:
        return " ".join(m[5] or "" for m in self.members)


def _islands(items: Iterable, start: Callable, end: Callable) -> Iterator[list]:
    """Items in order of their start, in groups that share no point."""
    group, reach = [], None
    for i in items:
        if group and start(i) > reach:
            yield group
            group = []
        group.append(i)
        reach = end(i) if reach is None else max(reach, end(i))
    if group:
        yield group


def gutters(regions: DataFrame) -> DataFrame:
    """section_id and its gutters as (g0, g1): x ranges that no region covers, inside and at least max(20, width / 16) wide.

    A section has fewer than sixteen.
    """

    def step(key, rows):
        found: list[tuple] = []
        reach = to = None  # of all boxes so far, and of those that hang together
        for x0, x1 in rows:
            if reach is not None and x0 > reach:
                # too narrow for the width so far is too narrow for the whole
                if to > 0 and x0 - to >= max(20, reach // 16):
                    found.append((to, x0))
                to = None
            to = x1 if to is None else max(to, x1)
            reach = to if reach is None else max(reach, to)
        found = [{"g0": g0, "g1": g1} for g0, g1 in found if g1 - g0 >= max(20, reach // 16)]
        if found:
            yield key[0], found

    x = regions.select("section_id", F.greatest("x0", F.lit(0)).alias("x0"), "x1")
    t = _type(regions, "x1")
    return fold(x, ["section_id"], ["x0", "x1"], step, f"section_id bigint, gutters array<struct<g0:{t},g1:{t}>>")


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _fit_lines(island: list[tuple], gaps: list[dict], cfg: Merge) -> list[list[tuple]]:
    lines: list[list] = []  # box and height of the last member, members
    found: list[list[tuple]] = []
    line_gap, h_ratio = cfg.line_gap, cfg.h_ratio
    for r in sorted(island, key=lambda r: (r[1], r[0])):
        _, x0, y0, x1, y1, _ = r
        h = y1 - y0
        lines = [n for n in lines if x0 - n[2] <= max(n[4], 0) * line_gap]  # the others lie behind for good
        for n in lines:
            base, gap = min(h, n[4]), x0 - n[2]
            if _share(n[1], n[3], y0, y1) < 0.5 or not -0.5 * base <= gap <= base * line_gap or max(h, n[4]) / max(1, base) > h_ratio:
                continue
            if any(n[2] <= g["g0"] and g["g1"] <= x0 for g in gaps):
                continue
            n[:5] = x0, y0, x1, y1, h
            n[5].append(r)
            break
        else:
            found.append([r])
            lines.append([x0, y0, x1, y1, h, found[-1]])
    return found


def _lines(rows: Iterable[tuple], cfg: Merge) -> Iterator[Line]:
    """The lines of a section whose boxes come from the top, after a row of its gutters if it has any; island by island."""
    rows, gaps = iter(rows), []
    first = next(rows)
    if first[6] is not None:
        gaps = first[6]
    else:
        rows = chain([first], rows)
    no = 0
    for island in _islands((r[:6] for r in rows), lambda r: r[2], lambda r: r[4]):
        order = lambda m: (m[0][2], m[0][1], m[0][0])
        numbered = enumerate(sorted(_fit_lines(island, gaps, cfg), key=order), no + 1)
        made = [
            Line(m[0][0], k, min(r[1] for r in m), min(r[2] for r in m), max(r[3] for r in m), max(r[4] for r in m), max(r[4] - r[2] for r in m), m[0][2], m[0][1], m)
            for k, m in numbered
        ]
        no += len(made)
        yield from sorted(made, key=lambda n: n.y0)


def _fit_paragraphs(island: list[Line], cfg: Merge) -> list[list[Line]]:
    groups: list[list] = []  # box and height of the last line, lines
    found: list[list[Line]] = []
    para_gap, h_ratio, overlap = cfg.para_gap, cfg.h_ratio, cfg.overlap
    # the order is that of first regions, whose top may be under the line's
    every = sorted(island, key=lambda n: (n.first_y0, n.first_x0, n.name))
    tops = list(accumulate((n.y0 for n in reversed(every)), min))[::-1]  # the highest of the lines to come
    for top, n in zip(tops, every):
        groups = [g for g in groups if top - g[3] <= max(g[4], 0) * para_gap]
        for g in groups:
            base, gap = min(n.h, g[4]), n.y0 - g[3]
            if not -0.3 * base <= gap <= base * para_gap or max(n.h, g[4]) / max(1, base) > h_ratio:
                continue
            if _share(g[0], g[2], n.x0, n.x1) < overlap and abs(g[0] - n.x0) > base * 0.5:
                continue
            g[:5] = n.x0, n.y0, n.x1, n.y1, n.h
            g[5].append(n)
            break
        else:
            found.append([n])
            groups.append([n.x0, n.y0, n.x1, n.y1, n.h, found[-1]])
    return found


def _paragraphs(lines: Iterable[Line], cfg: Merge) -> Iterator[list[list[Line]]]:
    """The paragraphs of lines in order of their tops, island by island."""
    for island in _islands(lines, lambda n: n.y0, lambda n: max(n.y1, ceil(n.y1 + n.h * cfg.para_gap))):
        yield _fit_paragraphs(island, cfg)


class Block(NamedTuple):
    """A paragraph with its number, box, and lines."""

    no: int
    x0: int
    y0: int
    x1: int
    y1: int
    lines: list[Line]

    @property
    def members(self) -> list[tuple]:
        return [m for n in self.lines for m in n.members]

    @property
    def text(self) -> str:
        return "\n".join(n.text for n in self.lines)


def _blocks(lines: Iterable[Line], cfg: Merge) -> Iterator[Block]:
    """Blocks from 1 by y0, then x0, then the first region of the first line."""
    no = 0
    for found in _paragraphs(lines, cfg):
        boxed = [(min(n.y0 for n in g), min(n.x0 for n in g), g[0].name, max(n.x1 for n in g), max(n.y1 for n in g), g) for g in found]
        for y0, x0, _, x1, y1, g in sorted(boxed, key=lambda b: b[:3]):
            no += 1
            yield Block(no, x0, y0, x1, y1, g)


def _sections(regions: DataFrame, cfg: Merge, step: Callable[[int, Iterator[Line]], Iterator[tuple]], columns: str, text: bool = False) -> DataFrame:
    """``step(section_id, lines)`` over the lines of each section; its rows begin with section_id."""
    boxes = regions.select("section_id", "region_id", *BOX, F.col("text") if text else F.lit(None).cast("string").alias("text"))
    if cfg.gutter:
        boxes = materialize(boxes if text else boxes.drop("text"), "boxes")
        boxes = boxes if text else boxes.withColumn("text", F.lit(None).cast("string"))
        t = _type(boxes, "x1")
        boxes = boxes.withColumn("gutters", F.lit(None).cast(f"array<struct<g0:{t},g1:{t}>>"))
        boxes = boxes.unionByName(gutters(boxes), allowMissingColumns=True)
    else:
        boxes = boxes.withColumn("gutters", F.lit(None).cast("array<struct<g0:bigint,g1:bigint>>"))
    rows = boxes.select("section_id", "region_id", *BOX, "text", "gutters")
    return fold(rows, ["section_id"], [F.asc_nulls_first("y0"), "region_id"], lambda key, found: step(key[0], _lines(found, cfg)), f"section_id bigint, {columns}")


def merge_lines(regions: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    """section_id, region_id, line_id, pos: the line of each region and its place there from 0.

    Regions go from left to right (ties: region_id). One joins the first line whose last
    member shares at least half of the lower height, has a gap from -0.5 to ``line_gap``
    lower heights and a ratio of heights up to ``h_ratio``, without a gutter between. A
    line is named by its first region.
    """

    def step(section, lines):
        for n in lines:
            for pos, m in enumerate(n.members):
                yield section, m[0], n.name, pos

    return _sections(regions, cfg, step, "region_id bigint, line_id bigint, pos bigint")


def lines_of(regions: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each line: its box, greatest height, text (regions joined by blanks), and the box of its first region."""
    m = regions.select("section_id", "region_id", "x0", "y0", "x1", "y1", "text").join(members, ["section_id", "region_id"])
    first = lambda c: F.min_by(c, "pos").alias(f"first_{c}")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    return m.groupBy("section_id", "line_id").agg(
        *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")),
        F.max(F.col("y1") - F.col("y0")).alias("h"), text.alias("text"), first("x0"), first("y0"), F.count(F.lit(1)).alias("n_regions"),
    )


_OF_LINES = "line_id bigint, block_id bigint, pos bigint"


def merge_paragraphs(lines: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    """section_id, line_id, block_id, pos: the paragraph of each line (rows of ``lines_of``), named by its first line.

    Lines go from top to bottom by their first region. One joins the first paragraph whose
    last line is -0.3 to ``para_gap`` lower heights above, has a ratio of heights up to
    ``h_ratio``, and shares ``overlap`` of the lesser width or begins within half a height.
    """

    def step(key, rows):
        return _members(key[0], _paragraphs((Line(r[0], 0, *r[1:]) for r in rows), cfg))

    s = lines.select("section_id", "line_id", *BOX, "h", "first_y0", "first_x0")
    return fold(s, ["section_id"], ["y0", "line_id"], step, f"section_id bigint, {_OF_LINES}")


def _members(section: int, found: Iterable[list[list[Line]]]) -> Iterator[tuple]:
    for g in chain.from_iterable(found):
        for pos, n in enumerate(g):
            yield section, n.name, g[0].name, pos


def build_blocks(regions: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    """Paragraphs as blocks: box, text (a row a line), upper median height of its regions, n_lines, ids of the
    regions in order, and block_id from 1 by y0, then x0. An empty table gives none; null text is empty."""

    def step(section, lines):
        for b in _blocks(lines, cfg):
            m = b.members
            yield section, *b[1:5], b.text, len(b.lines), float(sorted(r[4] - r[2] for r in m)[len(m) // 2]), sorted(r[0] for r in m), b.no

    # the median is a double, as an aggregate of Spark gives it
    columns = f"{_boxed(regions)}, text string, n_lines bigint, font_h double, regions array<bigint>, block_id bigint"
    return _sections(regions, cfg, step, columns, text=True)


def _boxed(regions: DataFrame) -> str:
    return ", ".join(f"{c} {_type(regions, c)}" for c in BOX)


def _numbered_units(regions: DataFrame, cfg: Merge, *wanted: str) -> DataFrame:
    """Lines, blocks, or both, from one pass."""

    def step(section, lines):
        def seen():
            for n in lines:
                if "line" in wanted:
                    out.append((section, "line", n.no, *n[2:6], n.text, len(n.members)))
                yield n

        out: list[tuple] = []
        if "block" in wanted:
            for b in _blocks(seen(), cfg):
                yield from out
                out.clear()
                yield section, "block", b.no, *b[1:5], b.text, len(b.members)
        else:
            for _ in seen():
                yield from out
                out.clear()
        yield from out

    return _sections(regions, cfg, step, f"unit string, unit_id bigint, {_boxed(regions)}, text string, n_regions bigint", text=True)


def units(regions: DataFrame, unit: str, cfg: Merge = Merge()) -> DataFrame:
    """section_id, unit_id, box, text, n_regions of the things to compare: regions as they are, lines, or blocks."""
    if unit == "region":
        return regions.select("section_id", F.col("region_id").alias("unit_id"), *BOX, "text", F.lit(1).cast("bigint").alias("n_regions"))
    if unit not in ("line", "block"):
        raise ValueError(f"unit is region, line or block, not {unit!r}")
    return _numbered_units(regions, cfg, unit).drop("unit")


def _rows(boxes: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (name, box, n) of boxes (region_id, x0, y0, x1, y1) that come from the top."""
    for island in _islands(boxes, lambda b: b[2], lambda b: b[4]):
        found: list[list] = []  # name, first box's y range, box so far, n
        for region, x0, y0, x1, y1 in island:
            for r in found:
                if _share(r[1], r[2], y0, y1) >= 0.5:
                    r[3:] = min(r[3], x0), min(r[4], y0), max(r[5], x1), max(r[6], y1), r[7] + 1
                    break
            else:
                found.append([region, y0, y1, x0, y0, x1, y1, 1])
        for r in found:
            yield r[0], *r[3:]


_ROWS = "block_id bigint, row bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, n bigint"


def group_lines(boxes: DataFrame) -> DataFrame:
    """Rows of the boxes of each block: section_id, block_id, row, box, n; rows go by their first box from the top.

    Boxes (section_id, block_id, region_id, x0 ... y1) go from the top (ties: region_id). One joins the
    first row whose *first* box shares at least half of the lower height. Rows are named by that box.
    """

    def step(key, rows):
        for r in _rows(rows):
            yield *key, *r

    b = boxes.select("section_id", "block_id", "region_id", *BOX)
    return fold(b, ["section_id", "block_id"], ["y0", "region_id"], step, f"section_id bigint, {_ROWS}")


def block_rows(regions: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    """``group_lines`` of the regions of ``build_blocks``, in the pass that makes the blocks."""

    def step(section, lines):
        for b in _blocks(lines, cfg):
            for r in _rows(sorted((m[:5] for m in b.members), key=lambda m: (m[2], m[0]))):
                yield section, b.no, *r

    return _sections(regions, cfg, step, _ROWS)


def align(rows: DataFrame, tol: float = 0.12, margin: float = 0.03) -> DataFrame:
    """section_id, block_id, align of the rows of ``group_lines``: the axis on which a block's rows vary least.

    single: one row or no width; any: all three within ``tol``; unknown: none within, or the first two closer than ``margin``.
    """
    w = F.max("x1") - F.min("x0")
    spread = lambda e: (F.max(e) - F.min(e)) / F.greatest(w, F.lit(1))
    d = rows.groupBy("section_id", "block_id").agg(
        F.count(F.lit(1)).alias("n"), w.alias("w"), spread(F.col("x0")).alias("l"), spread((F.col("x0") + F.col("x1")) / 2).alias("c"), spread(F.col("x1")).alias("r")
    )
    # equal spreads: left before center before right
    order = F.array_sort(F.array(*(F.struct(F.col(c).alias("s"), F.lit(k).alias("k")) for k, c in enumerate("lcr"))))
    least, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    name = F.get(F.array(*map(F.lit, ("left", "center", "right"))), least["k"])
    kind = F.when((F.col("n") < 2) | (F.col("w") <= 0), "single").when(F.greatest("l", "c", "r") <= tol, "any").when((least["s"] > tol) | (second["s"] - least["s"] < margin), "unknown").otherwise(name)
    return d.select("section_id", "block_id", kind.alias("align"))


@frame("C4_merge_lines", "regions")
def c4(regions: DataFrame, **cfg) -> DataFrame:
    return merge_lines(regions, Merge(**cfg))


@frame("C5_merge_paragraphs", "regions")
def c5(regions: DataFrame, **cfg) -> DataFrame:
    c = Merge(**cfg)
    return _sections(regions, c, lambda section, lines: _members(section, _paragraphs(lines, c)), _OF_LINES)


@frame("C6_paragraph_blocks", "regions")
def c6(regions: DataFrame, **cfg) -> DataFrame:
    b = build_blocks(regions, Merge(**cfg))
    return b.select("section_id", "block_id", "x0", "y0", "x1", "y1", F.sha2("text", 256).alias("text_sha"), "font_h", "n_lines", F.array_join(F.col("regions").cast("array<string>"), ",").alias("regions"))


@frame("C9_units", "regions")
def c9(regions: DataFrame, **cfg) -> DataFrame:
    """All three choices side by side."""
    regions = materialize(regions.select("section_id", "region_id", *BOX, "text"), "regions")
    found = _numbered_units(regions, Merge(**cfg), "line", "block")
    each = units(regions, "region").select(F.lit("region").alias("unit"), "*")
    return each.union(found.select(*each.columns))


@frame("G5_group_lines", "regions")
def g5(regions: DataFrame) -> DataFrame:
    return block_rows(regions)


@frame("G6_row_align", "regions")
def g6(regions: DataFrame, **cfg) -> DataFrame:
    return align(block_rows(regions), **cfg)
