"""Greedy cuts against plain restatements of their rules, on made-up pages with ties and limits met exactly."""

import random

import pytest
from compare import connect, difference

from pagegrain import plans
from pagegrain.operators import cuts
from pagegrain.plans.registry import run

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_thinning_is_that_of_the_recursion(spark):
    assert difference(plans.queries()["B9_thin_greedy"](spark, SF), connect(SF), plans.oracles()["B9_thin_greedy"]) is None


def test_thinning_by_hand(spark):
    c = spark.createDataFrame([(1, y) for y in (399, 400, 400, 799, 800, 1250, 1600, 1601)] + [(2, 500), (3, 500)], "page_id long, y long")
    h = spark.createDataFrame([(1, 2000), (2, 899)], "page_id long, h long")
    assert rows_of(cuts.thin_greedy(c, h), "page_id", "y") == [(1, 400), (1, 800), (1, 1250)]
    assert rows_of(cuts.thin_greedy(c, h, 1200), "page_id", "y") == []


def test_added_cuts_keep_their_distance(spark):
    rng = random.Random(2)
    base = [(p, y) for p in range(6) for y in rng.sample(range(0, 4000, 50), rng.randint(0, 3))]
    extra = [(p, y, a, a + 1500) for p in range(6) for a in (0, 1500, 3000) for y in rng.choices(range(a, a + 1500, 50), k=8)]
    want = []
    for p in range(6):
        have = [y for q, y in base if q == p]
        for _, y, a, b in sorted({e for e in extra if e[0] == p}, key=lambda e: e[1:]):
            if y - a >= 200 and b - y >= 200 and all(abs(y - c) >= 200 for c in have):
                have.append(y)
                want.append((p, y, a, b))
    got = cuts.add_cuts(spark.createDataFrame(base, "page_id long, y long"), spark.createDataFrame(extra, "page_id long, y long, a long, b long"), 200)
    assert rows_of(got, "page_id", "y", "a", "b") == sorted(want)


def test_accepted_picks_by_hand(spark):
    cands = spark.createDataFrame([(1, 0, n, 500 * n) for n in range(1, 6)], "page_id long, part long, no long, y long")
    said = ["3", "x", None, "9", "0", " 4 ", "-1", "3", "2.0", "1", "5"]
    answers = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(said)], "page_id long, part long, pos long, pick string")
    base = spark.createDataFrame([(1, 2900)], "page_id long, y long")
    assert rows_of(cuts.accept_picks(answers, cands, base, 400), "pick", "y") == [(1, 500), (3, 1500), (4, 2000), (5, 2500)]
    assert rows_of(cuts.accept_picks(answers, cands, base, 501), "pick", "y") == [(1, 500), (3, 1500)]


def test_merged_pieces_follow_the_colour_of_the_running_piece(spark):
    """By hand: short ones join, alike ones join, up to the length; a running piece takes the colour of its most rows."""
    grey = lambda g: g * 0x010101
    spans = [(0, 1300, 100), (1300, 1500, 200), (1500, 2800, 105), (2800, 4200, 100), (4200, 5500, 160), (5500, 6800, 165)]
    pieces = [(1, 0, a, b) for a, b, _ in spans] + [(2, 0, 0, 100), (2, 1, 100, 5000)]
    rows = [(1, y, grey(g)) for a, b, g in spans for y in range(a, b, 10)]
    got = cuts.merge_pieces(spark.createDataFrame(pieces, "page_id long, span long, y0 long, y1 long"), spark.createDataFrame(rows, "page_id long, y long, color long"))
    assert rows_of(got, "page_id", "span", "y0", "y1", "n") == [(1, 0, 0, 2800, 3), (1, 0, 2800, 4200, 1), (1, 0, 4200, 6800, 2), (2, 0, 0, 100, 1), (2, 1, 100, 5000, 1)]


def plain_split(lo, hi, runs, limit, least, band, overlap, seam="start"):
    if hi - lo <= limit:
        return [(lo, hi, lo, hi, seam)]
    ok = [(a + b) // 2 for a, b in runs if a > lo and b < hi and (a + b) // 2 - lo >= least and hi - (a + b) // 2 >= least]
    if ok:
        c = min(ok, key=lambda y: (abs(y - (lo + hi) / 2), y))
        return plain_split(lo, c, runs, limit, least, band, overlap, seam) + plain_split(c, hi, runs, limit, least, band, overlap, "blank")
    tops = list(range(lo, max(lo + 1, hi - overlap), band - overlap))
    out = []
    for t in tops:
        b = min(hi, t + band)
        out.append((t, b, t + overlap // 2 if t > lo else t, b if t == tops[-1] else b - overlap // 2, "band" if t > lo else seam))
    return out


def test_spans_split_as_restated(spark):
    rng = random.Random(8)
    runs, spans, want = [], [], []
    for p in range(25):
        at, mine = 0, []
        while at < 3000:
            at += rng.choice((5, 30, 60, 400, 900))
            mine.append((at, at + rng.choice((2, 8, 20))))
            at = mine[-1][1]
        mine = mine[: rng.choice((0, 1, 5, 40))]
        runs += [(p, *r) for r in mine]
        for s, (lo, hi) in enumerate(((0, 1500), (1500, 1501 + 10 * p), (2000, 3000))):
            spans.append((p, s, lo, hi))
            want += [(p, s, *x) for x in plain_split(lo, hi, mine, 300, 50, 200, 30)]
    got = cuts.split_span(spark.createDataFrame(spans, "page_id long, span long, lo long, hi long"), spark.createDataFrame(runs, "page_id long, y0 long, y1 long"), 300, 50, 200, 30)
    assert rows_of(got, "page_id", "span", "lo", "hi", "keep0", "keep1", "seam") == sorted(want)
    with pytest.raises(ValueError):
        cuts.split_span(got, got, band=10, overlap=10)


def test_seams_as_restated(spark):
    rng = random.Random(3)
    rows = [(p, y, rng.choice((0.2, 0.5, 0.6, 0.6, 0.9))) for p in range(4) for y in rng.sample(range(300), 80)]
    want = []
    for p in range(4):
        kept = []
        for y, f in sorted(((y, f) for q, y, f in rows if q == p and f >= 0.5), key=lambda r: (-r[1], r[0])):
            if all(abs(y - k) > 10 for k, _ in kept):
                kept.append((y, f))
        want += [(p, *k) for k in kept]
    assert rows_of(cuts.seam_lines(spark.createDataFrame(rows, "page_id long, y long, frac double")), "page_id", "y", "frac") == sorted(want)


def test_seam_ratio_by_hand(spark):
    """White columns do not count, and a row needs three tenths of its width."""
    grid = [[10, 10, 250, 10], [10, 14, 10, 20], [250, 250, 250, 90], [10, 10, 10, 10]]
    px = spark.createDataFrame([(1, y, x, g) for y, r in enumerate(grid) for x, g in enumerate(r)], "page_id long, y long, x long, gray long")
    assert rows_of(cuts.seam_ratio(px), "y", "frac") == [(0, 2 / 3), (1, 0.0), (2, 0.0)]


def test_empty_tables(spark):
    none = lambda cols: spark.createDataFrame([], cols)
    assert run(spark, "B21_split_span", page_spans=none("page_id long, span long, lo long, hi long"), wide_blanks=none("page_id long, y0 long, y1 long")).count() == 0
    assert run(spark, "B9_thin_greedy", blank_middles=none("page_id long, y long"), line_heights=none("page_id long, h long")).count() == 0


def test_rows_travel_as_stretches(spark):
    """Rows of equal steps and colours are one row of the shuffle; odd steps, gaps, equal places and nulls stay apart and whole."""
    from pagegrain.functions.stretch import stretches

    rows = [(1, 5, y) for y in range(0, 64000, 16)] + [(1, 5, y) for y in (64000, 64001, 64001, 66000, 65000)] + [(None, 5, 7), (1, None, 8), (2, 5, 9), (2, 5, 10)]
    df = spark.createDataFrame(rows, "page_id long, color long, y long").coalesce(1)
    got = stretches(df, "y", 1024).collect()
    back = [(r.page_id, r.color, r.y + k * r.step) for r in got for k in range(r.n)]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(back, key=key) == sorted(rows, key=key) and len(got) < 20


def test_pieces_count_rows_of_any_step_as_restated(spark):
    import random

    rng = random.Random(5)
    pieces = [(1, 0, 100 * i, 100 * i + rng.choice((60, 100))) for i in range(40)]
    rows = [(1, y, rng.choice((0x101010, 0xF0F0F0))) for y in range(0, 4000, 7)] + [(1, rng.randrange(4000), 0x808080) for _ in range(300)]
    got = run(spark, "B12_merge_pieces", page_pieces=spark.createDataFrame(pieces, "page_id long, span long, y0 long, y1 long"), page_rows=spark.createDataFrame(rows, "page_id long, y long, color long"), short=50, delta=20, most=900)
    main = lambda c: min(c, key=lambda k: (-c[k], k)) if c else 0
    want, now = [], None
    for _, _, a, b in pieces:
        c = {}
        for _, y, k in rows:
            if a <= y < b:
                c[k] = c.get(k, 0) + 1
        if now and b - now[0] <= 900 and (now[1] - now[0] < 50 or b - a < 50 or max(abs((main(now[3]) >> s & 255) - (main(c) >> s & 255)) for s in (0, 8, 16)) < 20):
            now[1:3] = b, now[2] + 1
            for k, n in c.items():
                now[3][k] = now[3].get(k, 0) + n
            continue
        if now:
            want.append(tuple(now[:3]))
        now = [a, b, 1, c]
    want.append(tuple(now[:3]))
    assert sorted((r.y0, r.y1, r.n) for r in got.collect()) == want
    plan = run(spark, "B12_merge_pieces", "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[-1]  # packed below the join
