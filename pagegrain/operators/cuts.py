"""Greedy cuts of pages: thinning, added and chosen cuts, merged pieces, spans split at blanks, seams.

What does not depend on what was kept before is a filter or a join; the rest is a fold whose
state is the last kept cut, or the kept cuts by stretches of the least distance.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import scan
from pagegrain.functions.fold import fold
from pagegrain.functions.stretch import stretches
from pagegrain.plans.registry import frame, view
from pagegrain.sources.scratch import materialize

LEAST_SECTION = 400


def thin_greedy(cands: DataFrame, heights: DataFrame, least: int = LEAST_SECTION) -> DataFrame:
    """page_id, y of the candidates kept from the top: ``least`` or more under the last kept one (at first 0) and above the end.

    ``cands``: page_id, y; ``heights``: page_id, h. Equal candidates count once; pages without a height keep none.
    """
    free = cands.select("page_id", "y").distinct().join(heights.select("page_id", "h"), "page_id").where(F.col("h") - F.col("y") >= least).select("page_id", "y")

    def step(key, rows):
        last = 0
        for (y,) in rows:
            if y - last >= least:
                last = y
                yield key[0], y

    return fold(free, ["page_id"], ["y"], step, "page_id bigint, y bigint")


class _Kept:
    """Kept numbers by stretches of ``least``: whether another is that far from all of them."""

    def __init__(self, least: int):
        self.least, self.at = max(1, least), {}

    def put(self, y: int) -> bool:
        b = y // self.least
        if any(abs(y - o) < self.least for k in (b - 1, b, b + 1) for o in self.at.get(k, ())):
            return False
        self.at.setdefault(b, []).append(y)
        return True


def far_from(cands: DataFrame, cuts: DataFrame, least: int) -> DataFrame:
    """Candidates (page_id, y, ...) with no cut (page_id, y) nearer than ``least``: an anti join by stretches of that length."""
    band = lambda y: F.floor(y / max(1, least))
    near = F.explode(F.array(*(band(F.col("y")) + k for k in (-1, 0, 1)))).alias("_band")
    taken = cuts.select(F.col("page_id").alias("_page"), F.col("y").alias("_cut"), near)
    same = (F.col("page_id") == F.col("_page")) & (band(F.col("y")) == F.col("_band")) & (F.abs(F.col("y") - F.col("_cut")) < least)
    return cands.join(taken, same, "left_anti")


def add_cuts(base: DataFrame, extra: DataFrame, least: int = LEAST_SECTION, order: list[str] | None = None) -> DataFrame:
    """The rows of ``extra`` that are added: ``least`` or more from all cuts of ``base``, from those added before, and from
    the ends of their own range.

    ``base``: page_id, y; ``extra``: page_id, y, a, b (the range), and what ``order`` names (default: y); equal rows count once.
    """
    order = order or ["y"]
    inner = extra.where((F.col("y") - F.col("a") >= least) & (F.col("b") - F.col("y") >= least))
    free = far_from(inner, base, least).select("page_id", "y", "a", "b", *(c for c in order if c not in ("y", "a", "b"))).distinct()

    def step(key, rows):
        kept = _Kept(least)
        for y, a, b, *_ in rows:
            if kept.put(y):
                yield key[0], y, a, b

    return fold(free, ["page_id"], [*order, "y", "a", "b"], step, "page_id bigint, y bigint, a bigint, b bigint")


def accept_picks(answers: DataFrame, cands: DataFrame, base: DataFrame, least: int = LEAST_SECTION) -> DataFrame:
    """page_id, part, pick, y of accepted answers: whole numbers that name a candidate at least ``least`` from all cuts so far.

    ``answers``: page_id, part, pos, pick (text); ``cands``: page_id, part, no (from 1), y; ``base``: page_id, y. Answers
    count in order of part and pos; text that is no whole number, or out of range, is left out.
    """
    whole = F.when(F.col("pick").rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim("pick").try_cast("bigint"))
    a = answers.select("page_id", "part", "pos", whole.alias("no")).where("no is not null")
    found = far_from(a.join(cands, ["page_id", "part", "no"]), base, least).select("page_id", "part", "pos", "no", "y")

    def step(key, rows):
        kept = _Kept(least)
        for part, _, no, y in rows:
            if kept.put(y):
                yield key[0], part, no, y

    return fold(found, ["page_id"], ["part", "pos", "no", "y"], step, "page_id bigint, part bigint, pick bigint, y bigint")


def _channels(key: int) -> tuple[int, int, int]:
    return key >> 16, key >> 8 & 255, key & 255


def merge_pieces(pieces: DataFrame, rows: DataFrame, short: int = 1200, delta: int = 20, most: int = 3000) -> DataFrame:
    """page_id, span, y0, y1, n: neighbouring pieces of a span merged from the top while one of both is under ``short`` or
    their main colours differ by less than ``delta`` in every channel, up to a length of ``most``.

    ``pieces``: page_id, span, y0, y1; ``rows``: page_id, y, color (24 bits). The main colour is that of the most rows of all
    of the running piece (ties: the least); a piece without rows is black.
    """
    band = 1024
    p = pieces.select("page_id", "span", "y0", "y1", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor((F.col("y1") - 1) / band))).alias("band"))
    # rows of one colour at equal distances travel as one stretch, cut into bands only after it is packed
    r = stretches(rows.select("page_id", "color", F.col("y").cast("bigint").alias("ry")).where("ry is not null"), "ry", band)
    r = r.select("*", F.explode(F.sequence(F.floor(F.col("ry") / band), F.floor((F.col("ry") + (F.col("n") - 1) * F.col("step")) / band))).alias("band"))
    above = lambda y: F.least(F.col("n"), F.greatest(F.lit(0), F.ceil((y - F.col("ry")) / F.col("step"))))  # noqa: E731  rows of a stretch above y
    inside = above(F.least(F.col("y1"), (F.col("band") + 1) * band)) - above(F.greatest(F.col("y0"), F.col("band") * band))
    seen = p.join(r, ["page_id", "band"]).withColumn("inside", inside).where("inside > 0").groupBy("page_id", "span", "y0", "y1", "color").agg(F.sum("inside").alias("n"))
    seen = seen.groupBy("page_id", "span", "y0", "y1").agg(F.collect_list(F.struct("color", "n")).alias("colors"))
    p = pieces.select("page_id", "span", "y0", "y1").join(seen, ["page_id", "span", "y0", "y1"], "left")

    def main(c: Counter) -> tuple[int, int, int]:
        return _channels(min(c, key=lambda k: (-c[k], k)) if c else 0)

    def step(key, found):
        now = None  # y0, y1, n, colours
        for y0, y1, colors in found:
            c = Counter({x["color"]: x["n"] for x in colors or ()})
            if now:
                small = now[1] - now[0] < short or y1 - y0 < short
                if y1 - now[0] <= most and (small or max(abs(a - b) for a, b in zip(main(now[3]), main(c))) < delta):
                    now[3].update(c)
                    now[1:3] = y1, now[2] + 1
                    continue
                yield (*key, *now[:3])
            now = [y0, y1, 1, c]
        if now:
            yield (*key, *now[:3])

    return fold(p, ["page_id", "span"], ["y0", "y1"], step, "page_id bigint, span bigint, y0 bigint, y1 bigint, n bigint")


def split_span(spans: DataFrame, blanks: DataFrame, limit: int = 4000, least: int = 200, band: int = 2000, overlap: int = 300) -> DataFrame:
    """Pieces of spans over ``limit``: page_id, span, lo, hi, keep0, keep1, seam (how the piece begins: start, blank or band).

    ``spans``: page_id, span, lo, hi; ``blanks``: page_id, y0, y1 (runs of blank rows). A long span is cut at the middle of the
    run inside it that is nearest to its own middle (ties: the upper one) and leaves ``least`` on both sides; both parts go on
    likewise. Where no run fits, bands with an overlap cover it, and each keeps what lies between the middles of overlaps. Every
    cut leaves ``least``, so a span has at most (hi - lo) / least pieces.
    """
    if not 0 < overlap < band or least < 1:
        raise ValueError("bands must be longer than their overlap, and pieces at least one row")
    runs = blanks.select("page_id", F.struct("y0", "y1").alias("run"))
    long = spans.where(F.col("hi") - F.col("lo") > limit)
    inside = long.join(runs, "page_id").where("run.y0 > lo and run.y1 < hi").groupBy("page_id", "span", "lo", "hi").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    d = spans.select("page_id", "span", "lo", "hi").join(inside, ["page_id", "span", "lo", "hi"], "left")

    def step(key, found):
        for lo, hi, inner in found:
            a, b = ([r[k] for r in inner or ()] for k in ("y0", "y1"))
            mid = [(x + y) // 2 for x, y in zip(a, b)]
            todo = [(lo, hi, "start")]
            while todo:
                p, q, seam = todo.pop()
                best = None
                if q - p > limit:
                    # runs do not meet, so that starts, ends and middles ascend alike; outwards from the middle of the span
                    j = bisect_left(mid, (p + q) / 2)
                    for side in (range(j - 1, -1, -1), range(j, len(mid))):
                        for k in side:
                            if not p < mid[k] < q:
                                break
                            if a[k] > p and b[k] < q and mid[k] - p >= least and q - mid[k] >= least:
                                if best is None or abs(2 * mid[k] - p - q) < abs(2 * best - p - q):
                                    best = mid[k]
                                break
                    if best is not None:
                        todo += [(best, q, "blank"), (p, best, seam)]
                        continue
                    tops = range(0, max(1, q - p - overlap), band - overlap)
                    for i, t in enumerate(tops):
                        end = min(q - p, t + band)
                        keep = t + (overlap // 2 if i else 0), end - (overlap // 2 if i < len(tops) - 1 else 0)
                        yield (*key, p + t, p + end, p + keep[0], p + keep[1], "band" if i else seam)
                else:
                    yield (*key, p, q, p, q, seam)

    return fold(d, ["page_id", "span"], ["lo", "hi"], step, "page_id bigint, span bigint, lo bigint, hi bigint, keep0 bigint, keep1 bigint, seam string")


def seam_ratio(pixels: DataFrame, jump: int = 3, white: int = 245, least: float = 0.3) -> DataFrame:
    """page_id, y, frac: of the columns where neither row y nor y + 1 is white, the share that differs by more than ``jump``;
    0 where they are under ``least`` of the width. ``pixels``: page_id, y, x, gray."""
    below = pixels.select("page_id", (F.col("y") - 1).alias("y"), "x", F.col("gray").alias("next"))
    valid = (F.col("gray") <= white) & (F.col("next") <= white)
    d = pixels.join(below, ["page_id", "y", "x"]).groupBy("page_id", "y").agg(
        F.count(F.lit(1)).alias("width"), F.count_if(valid).alias("n"), F.count_if(valid & (F.abs(F.col("gray") - F.col("next")) > jump)).alias("hit")
    )
    frac = F.when((F.col("n") > 0) & (F.col("n") >= least * F.col("width")), F.col("hit") / F.col("n")).otherwise(0.0)
    return d.select("page_id", "y", frac.alias("frac"))


def seam_lines(ratios: DataFrame, least: float = 0.5, apart: int = 10) -> DataFrame:
    """page_id, y, frac of rows with a share of ``least`` or more, the strongest first (ties: the upper), each more than
    ``apart`` rows from all stronger ones kept. Rows that far from others are islands of their own."""
    c = materialize(ratios.where(F.col("frac") >= least).select("page_id", "y", "frac"), "seams")  # read four times by the islands
    c = scan.islands(c, ["page_id"], F.col("y"), F.col("y") + apart, 4096, "island")

    def step(key, rows):
        kept = _Kept(apart + 1)
        for y, frac in rows:
            if kept.put(y):
                yield key[0], y, frac

    return fold(c, ["page_id", "island"], [F.desc("frac"), "y"], step, "page_id bigint, y bigint, frac double")


@view
def blank_middles(d):
    return f"select page_id, {d.floordiv('y0 + y1', '2')} as y from blank_runs"


@view
def line_heights(d):
    return "select page_id, max(y) + 1 as h from pages_of_lengths group by page_id"


@view
def page_heights(d):
    return "select page_id, max(y1) as h from sections group by page_id"


@view
def wide_blanks(d):
    """Blank runs of a page: the first tenth of each section of 60 or more."""
    return f"select page_id, y0, y0 + {d.floordiv('y1 - y0', '10')} as y1 from sections where y1 - y0 >= 60 and idx > 0"


@view
def middles(d):
    """Middles of sections as candidates, in the range between every fifth cut of their page."""
    fifth = d.floordiv("idx", "5")
    return f"""select page_id, part, row_number() over (partition by page_id, part order by y, section_id) as no, y, min(y0) over (partition by page_id, part) as a, max(y1) over (partition by page_id, part) as b
        from (select page_id, section_id, {fifth} as part, {d.floordiv('y0 + y1', '2')} as y, y0, y1 from sections) q"""


@view
def fifths(d):
    return "select page_id, y0 as y from sections where idx > 0 and idx % 5 = 0"


@view
def picks(d):
    """Answers that name candidates: in range, out of range, twice, and in words."""
    return """select page_id, part, no as pos, case when no % 4 = 0 then 'none' when no % 7 = 0 then '99' else cast(1 + (no * 3) % 5 as varchar(9)) end as pick from middles"""


@view
def page_pieces(d):
    return f"select page_id, {d.floordiv('idx', '10')} as span, y0, y1 from sections where y1 > y0"


@view
def page_rows(d):
    """Rows of pages in steps of 16, with a colour for each section."""
    gray = "(section_id * 37) % 4 * 40 + 40"
    return f"select page_id, k * 16 as y, cast(({gray}) * 65536 + ({gray}) * 256 + ({gray}) as bigint) as color from sections {d.series(d.floordiv('y0 + 15', '16'), d.floordiv('y1 - 1', '16'), 'k')}"


@view
def page_spans(d):
    return "select page_id, cast(0 as bigint) as span, cast(0 as bigint) as lo, max(y1) as hi from sections group by page_id"


def _chain(cands: str, heights: str, least: int) -> str:
    """The same thinning as a recursion: the next cut is the nearest one that far below the last."""
    return f"""with recursive c as (select distinct x.page_id, x.y from {cands} x join {heights} p on x.page_id = p.page_id where p.h - x.y >= {least}),
        k as (select page_id, min(y) as y from c where y >= {least} group by page_id union all
        select k.page_id, (select min(c.y) from c where c.page_id = k.page_id and c.y >= k.y + {least}) as y from k where k.y is not null)
        select page_id, y from k where y is not null"""


@frame("B9_thin_greedy", "blank_middles", "line_heights", check=lambda d: _chain("blank_middles", "line_heights", 4))
def b9(cands: DataFrame, heights: DataFrame, least: int = 4) -> DataFrame:
    return thin_greedy(cands, heights, least)


@frame("B13_add_cuts", "fifths", "middles")
def b13(base: DataFrame, extra: DataFrame, least: int = 200) -> DataFrame:
    return add_cuts(base, extra, least)


@frame("B15_accept_picks", "picks", "middles", "fifths")
def b15(answers: DataFrame, cands: DataFrame, base: DataFrame, least: int = 200) -> DataFrame:
    return accept_picks(answers, cands.select("page_id", "part", "no", "y"), base, least)


@frame("B12_merge_pieces", "page_pieces", "page_rows")
def b12(pieces: DataFrame, rows: DataFrame, **limits) -> DataFrame:
    return merge_pieces(pieces, rows, **limits)


@frame("B21_split_span", "page_spans", "wide_blanks")
def b21(spans: DataFrame, blanks: DataFrame, **limits) -> DataFrame:
    return split_span(spans, blanks, **limits)


@frame("B29_seam_lines", "pixels")
def b29(pixels: DataFrame, jump: int = 3, least: float = 0.95, apart: int = 10) -> DataFrame:
    return seam_lines(seam_ratio(pixels, jump), least, apart).withColumn("frac", F.bround("frac", 6))
