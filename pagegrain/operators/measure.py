"""Text in boxes: widths from a glyph table, greedy wrapping, and the scales and heights that fit.

A width is a number of thousandths of an em for each character. Larger letters never take fewer
lines nor less height, so what fits is said by the largest size in pixels that does: it is
searched for by halves, and a scale is compared with it. Words are measured once, and a line goes
as far as the running sum of widths says, for many rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.plans.registry import frame, view

EM, LINE = 1.35, 1.2
SHRINK = (1.0, 0.95, 0.9, 0.85, 0.8)
NEED = tuple(round(1 - 0.05 * i, 2) for i in range(15))
#: thousandths of an em: narrow and wide letters, others as ``GLYPH``
GLYPHS = {**dict.fromkeys("iljtf.,;:'|! ", 300), **dict.fromkeys("mwMW@", 900)}
GLYPH, GLYPHS_MOST = 550, 10_000


@dataclass(frozen=True)
class Fit:
    """Whether text may wrap, the scales tried in order, and how far the box may grow in height."""

    wrap: bool = True
    shrink: Sequence[float] = SHRINK
    grow: float = 1.0


def text_width(text: Column, glyphs: Mapping[str, int] = GLYPHS, other: int = GLYPH) -> Column:
    """Width of a text in thousandths of an em."""
    if len(glyphs) > GLYPHS_MOST:
        raise ValueError(f"a glyph table has at most {GLYPHS_MOST} entries")
    total = F.length(text).cast("bigint") * other
    by_width: dict[int, str] = {}
    for c, w in glyphs.items():
        by_width[w] = by_width.get(w, "") + c
    for w, chars in by_width.items():
        total += (F.length(text) - F.length(F.translate(text, chars, ""))) * (w - other)
    return total


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def wrap_lines(widths: Column, box: Column, px: Column, blank: int = GLYPHS[" "]) -> Column:
    """How many lines words of these widths take in a box; null if one alone is too wide; no words take one line.

    A word goes on the current line if the line, a blank and the word fit the box.
    """
    room = box * 1000
    start = F.struct(F.lit(1).alias("n"), F.lit(-1).cast("bigint").alias("w"), F.lit(False).alias("bad"))

    def put(a: Column, w: Column) -> Column:
        on = F.when(a["w"] < 0, w).otherwise(a["w"] + blank + w)
        fits = on * px <= room
        opens = ~fits & (a["w"] >= 0)
        return F.struct((a["n"] + opens.cast("int")).alias("n"), F.when(fits, on).otherwise(w).cast("bigint").alias("w"), (a["bad"] | (w * px > room)).alias("bad"))

    return F.aggregate(widths, start, put, lambda a: F.when(~a["bad"], a["n"]))


def pixels(em: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(em * scale)).cast("bigint")


_FITTED = pa.struct([("width", pa.int64()), ("best", pa.list_(pa.int64())), ("lines", pa.list_(pa.int64()))])
#: characters that are looked at together, so that their arrays stay in the cache
CHARS = 1 << 16


def _table(glyphs: Mapping[str, int], other: int) -> np.ndarray:
    table = np.full(0x110000, other, np.int64)
    for chars, w in glyphs.items():
        table[[ord(c) for c in chars]] = w
    if (table < 0).any():
        raise ValueError("widths are not negative")
    return table


class _Words:
    """The words of some texts by their running widths, a blank after each."""

    def __init__(self, texts: list[str], table: np.ndarray, blank: int):
        self.blank = blank
        every = "".join(texts)
        code = np.frombuffer(every.encode("ascii"), "u1") if every.isascii() else np.frombuffer(every.encode("utf-32-le", "surrogatepass"), "<u4")
        size = [len(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), size)
        width = table[code]
        to = np.r_[0, np.cumsum(width)]
        end = np.cumsum(size)
        self.width = to[end] - to[end - size]
        blank = ((code >= 9) & (code <= 13)) | (code == 32)
        opens = np.flatnonzero(~blank & np.r_[True, blank[:-1] | (row[1:] != row[:-1])][: len(code)])
        widths = np.add.reduceat(np.where(blank, 0, width), opens) if len(opens) else np.zeros(0, np.int64)
        self.count = np.bincount(row[opens], minlength=len(texts))
        self.end = np.cumsum(self.count)
        self.to = np.r_[0, np.cumsum(widths + self.blank)]
        self.widest = np.zeros(len(texts), np.int64)
        np.maximum.at(self.widest, row[opens], widths)

    def lines(self, row: np.ndarray, room: np.ndarray, px: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Lines of these rows at these sizes, 0 if a word is too wide, more than ``most`` once that is passed; without a word 1."""
        cap, end = room // px, self.end[row]
        at, n = end - self.count[row], (self.count[row] == 0).astype(np.int64)
        live = np.flatnonzero((self.count[row] > 0) & (self.widest[row] <= cap))
        while live.size:
            at[live] = np.minimum(np.searchsorted(self.to, cap[live] + self.blank + self.to[at[live]], "right") - 1, end[live])
            n[live] += 1
            go = at[live] < end[live]
            live = live[go if most is None else go & (n[live] <= most[live])]
        return n

    def largest(self, room: np.ndarray, high: np.ndarray, up_to: np.ndarray) -> np.ndarray:
        """The largest size from 1 to ``up_to`` at which a text is no higher than ``high``; 0 if none is."""
        lo, hi = np.zeros(len(room), np.int64), up_to.copy()
        while (row := np.flatnonzero(lo < hi)).size:
            px = (lo[row] + hi[row] + 1) // 2
            n = self.lines(row, room[row], px, (np.clip(high[row], 0, 2.0**53) / (px * LINE)).astype(np.int64) + 1)
            ok = (n > 0) & (n * px * LINE <= high[row])
            lo[row[ok]] = px[ok]
            hi[row[~ok]] = px[~ok] - 1
        return lo


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHARS`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def fitted(text: Column, room: Column, heights: Column, up_to: Column, px: Column, glyphs: Mapping[str, int] = GLYPHS, other: int = GLYPH) -> Column:
    """width, best, lines: the width of the text on one line; for each of ``heights`` the largest size from 1 to ``up_to`` at which it,
    wrapped, is no higher (null: none); for each size of ``px`` its lines (null if a word is too wide). ``room``: a line's width in
    thousandths of a pixel."""

    @F.arrow_udf("struct<width:bigint,best:array<bigint>,lines:array<bigint>>")
    def fit(text: pa.Array, room: pa.Array, heights: pa.Array, up_to: pa.Array, px: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], _FITTED)
        texts, table, blank = text.to_pylist(), _table(glyphs, other), glyphs.get(" ", GLYPH)
        wide = room.fill_null(-1).to_numpy(zero_copy_only=False)  # without a width no word fits
        size = up_to.to_numpy(zero_copy_only=False)
        high = heights.flatten().fill_null(-1.0).to_numpy(zero_copy_only=False).reshape(len(texts), -1)
        sizes = px.flatten().to_numpy(zero_copy_only=False).reshape(len(texts), -1)
        width, best, lines = np.zeros(len(texts), np.int64), np.zeros(high.shape, np.int64), np.zeros(sizes.shape, np.int64)
        for a, b in _parts(texts):
            w, every = _Words(texts[a:b], table, blank), np.arange(b - a)
            width[a:b] = w.width
            for k in range(high.shape[1]):
                best[a:b, k] = w.largest(wide[a:b], high[a:b, k], size[a:b])
            for k in range(sizes.shape[1]):
                lines[a:b, k] = w.lines(every, wide[a:b], sizes[a:b, k])

        def each(found: np.ndarray) -> pa.Array:
            flat = pa.array(found.ravel(), mask=found.ravel() == 0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * found.shape[1], pa.int32()), flat)

        return pa.StructArray.from_arrays([pa.array(width), each(best), each(lines)], fields=list(_FITTED))

    return fit(text, room, heights, up_to, px)


def _em(em_ratio: float, lines: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.col("box_h") / lines * em_ratio)).cast("bigint")


def _room() -> Column:
    return F.floor(F.col("box_w") * 1000).cast("bigint")


def _first(scales: Sequence[float], test) -> Column:
    return F.get(F.filter(F.array(*(F.lit(float(s)) for s in scales)), test), F.lit(0)) if scales else F.lit(None).cast("double")


def _at_most(em: Column, best: Column):
    return lambda s: F.coalesce(pixels(em, s) <= best, F.lit(False))


def measure(segments: DataFrame, cfg: Fit = Fit(), em_ratio: float = EM, glyphs: Mapping[str, int] = GLYPHS) -> DataFrame:
    """em, ratio, fit_scale, need_scale, need_grow, need_grow_80 and overflow of each segment.

    ``segments``: seg_id, target (text), box_w, box_h, src_lines. em: height of a source line times
    ``em_ratio``; ratio: width at full size against that of the box's lines; fit_scale: the first of the scales at which
    the text fits; need_scale: the largest scale from 1 down to 0.3 at which it fits when wrapped; need_grow: height needed at
    full size (and at 0.8) against the box. Null where nothing fits; null text is empty and takes one line.
    """
    lines = F.greatest(F.lit(1), F.coalesce("src_lines", F.lit(1)))
    text, em = F.coalesce("target", F.lit("")), F.col("em")
    d = segments.select("seg_id", "box_w", "box_h", lines.alias("lines"), _em(em_ratio, lines).alias("em"), text.alias("text"))
    up_to = pixels(em, F.lit(float(max((*NEED, *cfg.shrink)))))
    heights = F.array(*((F.col("box_h") * g + 1).cast("double") for g in (1.0, cfg.grow)))
    d = d.withColumn("fit", fitted(F.col("text"), _room(), heights, up_to, F.array(pixels(em, F.lit(1.0)), pixels(em, F.lit(0.8))), glyphs))
    best = lambda k: F.get("fit.best", F.lit(k))
    on_one = lambda s: F.coalesce(F.col("fit.width") * pixels(em, s) <= F.col("box_w") * 1000, F.lit(False))
    fit_scale = _first(cfg.shrink, _at_most(em, best(1)) if cfg.wrap else on_one)
    grown = lambda k, scale: F.bround(F.get("fit.lines", F.lit(k)) * pixels(em, F.lit(scale)) * LINE / F.greatest(F.lit(1), F.col("box_h")), 2)
    ratio = F.bround(F.col("fit.width") * em / 1000 / F.greatest(F.lit(1), F.col("box_w") * F.col("lines")), 2)
    d = d.select("seg_id", "em", ratio.alias("ratio"), fit_scale.alias("fit_scale"), _first(NEED, _at_most(em, best(0))).alias("need_scale"), grown(0, 1.0).alias("need_grow"), grown(1, 0.8).alias("need_grow_80"))
    return d.withColumn("overflow", F.col("fit_scale").isNull())


def sensitivity(segments: DataFrame, ems: Sequence[float] = (0.9, 1.0, 1.1, 1.35)) -> DataFrame:
    """For each em ratio: share of segments that need no scale under 0.8 and 0.5, or no more than 2 and 3 times the height.

    The largest size that fits is the same for all ratios, so texts are measured once.
    """
    lines = F.greatest(F.lit(1), F.coalesce("src_lines", F.lit(1)))
    names = [f"em{i}" for i in range(len(ems))]
    d = segments.select("box_w", "box_h", F.coalesce("target", F.lit("")).alias("text"), *(_em(r, lines).alias(n) for r, n in zip(ems, names)))
    sizes = [pixels(F.col(n), F.lit(1.0)) for n in names]
    d = d.withColumn("fit", fitted(F.col("text"), _room(), F.array((F.col("box_h") * 1.0 + 1).cast("double")), F.array_max(F.array(*sizes)), F.array(*sizes)))
    share = lambda test: F.bround(F.count_if(test) / F.count(F.lit(1)), 6)
    each = []
    for i, (r, n) in enumerate(zip(ems, names)):
        scale = _first(NEED, _at_most(F.col(n), F.get("fit.best", F.lit(0))))
        grow = F.bround(F.get("fit.lines", F.lit(i)) * sizes[i] * LINE / F.greatest(F.lit(1), F.col("box_h")), 2)
        tests = {"scale_80": scale >= 0.8, "scale_50": scale >= 0.5, "grow_2": grow <= 2, "grow_3": grow <= 3}
        each.append(F.struct(F.lit(float(r)).alias("em"), *(share(t).alias(c) for c, t in tests.items())))
    return d.agg(F.array(*each).alias("each")).select(F.inline("each"))


@view
def boxed(d):
    """Outputs in the boxes of their sources, eight to a character, two lines if the source is long."""
    two = "(case when length(source) % 3 = 0 then 2 else 1 end)"
    return f"select seg_id, translation as target, cast(greatest(16, {d.floordiv('7 * length(source)', two)}) as bigint) as box_w, cast(20 * {two} as bigint) as box_h, {two} as src_lines from segments where target = 'a'"


@frame("K4_wrap_lines", "boxed")
def k4(segments: DataFrame, px: int = 12, glyphs: Mapping[str, int] = GLYPHS) -> DataFrame:
    widths = F.transform(words(F.coalesce("target", F.lit(""))), lambda w: text_width(w, glyphs))
    return segments.select("seg_id", widths.alias("w"), "box_w").select("seg_id", wrap_lines(F.col("w"), F.col("box_w"), F.lit(px), glyphs.get(" ", GLYPH)).alias("lines"))


@frame("K6_measure", "boxed")
def k6(segments: DataFrame, cfg: Fit = Fit(), em_ratio: float = EM, glyphs: Mapping[str, int] = GLYPHS) -> DataFrame:
    return measure(segments, cfg, em_ratio, glyphs)


@frame("K11_em_assumption", "boxed")
def k11(segments: DataFrame, ems: Sequence[float] = (0.9, 1.0, 1.1, 1.35)) -> DataFrame:
    return sensitivity(segments, ems)
