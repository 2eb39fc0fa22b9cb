"""Lines, paragraphs, blocks and rows of boxes against plain restatements of their rules."""

import random

import pytest

from pagegrain.operators import lines
from pagegrain.operators.lines import Merge
from pagegrain.plans.registry import run, view_of

SF = "/root/testdata/sf0.001"
REGIONS = "section_id long, region_id long, x0 long, y0 long, x1 long, y1 long, text string"


def made(seed=4, sections=30):
    """Boxes on a coarse grid, so that heights, gaps and overlaps meet their limits, with ties and equal boxes."""
    rng = random.Random(seed)
    rows = []
    for s in range(sections):
        for r in range(rng.choice((0, 1, 2, 12, 40))):
            x, y, h = rng.randrange(0, 400, 5), rng.randrange(0, 300, 4), rng.choice((8, 10, 12, 16, 20, 24))
            rows.append((s, r, x, y, x + rng.choice((5, 20, 40, 60)), y + h, rng.choice(("a", "b c", "", None))))
    return rows


def by_section(rows):
    out = {}
    for s, *r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(s, {})[r[0]] = r[1:]
    return out


def share(a0, a1, b0, b1):
    return max(0, min(a1, b1) - max(a0, b0)) / max(1, min(a1 - a0, b1 - b0))


def free_ranges(boxes):
    w = max(b[2] for b in boxes)
    used = {x for b in boxes for x in range(max(0, b[0]), b[2])}
    out, x = [], 0
    while x < w:
        if x in used:
            x += 1
            continue
        y = x
        while y < w and y not in used:
            y += 1
        if x > 0 and y < w and y - x >= max(20, w // 16):
            out.append((x, y))
        x = y
    return out


def first_fit(items, fits):
    groups = []
    for i in items:
        home = next((g for g in groups if fits(g[-1], i)), None)
        home.append(i) if home else groups.append([i])
    return groups


def plain_lines(boxes, cfg):
    gaps = free_ranges(list(boxes.values())) if cfg.gutter and boxes else []

    def fits(j, i):
        a, b = boxes[j], boxes[i]
        low, high = sorted((a[3] - a[1], b[3] - b[1]))
        gap = b[0] - a[2]
        apart = any(a[2] <= g and h <= b[0] for g, h in gaps)
        return share(a[1], a[3], b[1], b[3]) >= 0.5 and -low * 0.5 <= gap <= low * cfg.line_gap and high / max(1, low) <= cfg.h_ratio and not apart

    found = first_fit(sorted(boxes, key=lambda i: (boxes[i][0], i)), fits)
    return sorted(found, key=lambda g: (boxes[g[0]][1], boxes[g[0]][0], g[0]))


def union(boxes):
    return tuple(f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))


def plain_paragraphs(boxes, found, cfg):
    box = [union([boxes[i] for i in g]) for g in found]
    height = [max(boxes[i][3] - boxes[i][1] for i in g) for g in found]

    def fits(j, k):
        low, high = sorted((height[j], height[k]))
        gap = box[k][1] - box[j][3]
        beside = share(box[j][0], box[j][2], box[k][0], box[k][2]) >= cfg.overlap or abs(box[j][0] - box[k][0]) <= low * 0.5
        return -low * 0.3 <= gap <= low * cfg.para_gap and high / max(1, low) <= cfg.h_ratio and beside

    return first_fit(range(len(found)), fits)


CFGS = [Merge(), Merge(line_gap=1.0, para_gap=0.8, h_ratio=2.0, overlap=0.4, gutter=False)]


@pytest.mark.parametrize("cfg", CFGS)
def test_lines_and_blocks_as_restated(spark, cfg):
    rows = made()
    df = spark.createDataFrame(rows, REGIONS)
    got = {}
    for r in lines.merge_lines(df, cfg).collect():
        got.setdefault(r.section_id, {}).setdefault(r.line_id, []).append((r.pos, r.region_id))
    blocks = {}
    for r in lines.build_blocks(df, cfg).orderBy("section_id", "block_id").collect():
        blocks.setdefault(r.section_id, []).append(((r.x0, r.y0, r.x1, r.y1), r.text, r.font_h, r.n_lines, list(r.regions)))
    for s, boxes in by_section(rows).items():
        found = plain_lines(boxes, cfg)
        assert sorted([i for _, i in sorted(g)] for g in got[s].values()) == sorted(found)
        want = []
        for g in plain_paragraphs(boxes, found, cfg):
            ids = [i for k in g for i in found[k]]
            hs = sorted(boxes[i][3] - boxes[i][1] for i in ids)
            text = "\n".join(" ".join(boxes[i][4] or "" for i in found[k]) for k in g)
            want.append((union([boxes[i] for i in ids]), text, hs[len(hs) // 2], len(g), sorted(ids)))
        assert sorted(blocks[s]) == sorted(want)
        assert [b[0][1] for b in blocks[s]] == sorted(b[0][1] for b in blocks[s])


def test_blocks_of_the_tables_as_restated(spark):
    r = view_of(spark, "regions", SF).select("section_id", "region_id", "x0", "y0", "x1", "y1", "text")
    want = 0
    for boxes in by_section([tuple(x) for x in r.collect()]).values():
        want += len(plain_paragraphs(boxes, plain_lines(boxes, Merge()), Merge()))
    assert lines.build_blocks(r).count() == want > 0


def test_units_cover_every_region_once(spark):
    df = spark.createDataFrame(made(9, 8), REGIONS)
    for r in run(spark, "C9_units", regions=df).groupBy("unit").sum("n_regions").collect():
        assert r[1] == df.count()
    with pytest.raises(ValueError):
        lines.units(df, "page")


def test_rows_of_a_block_compare_with_the_first_box(spark):
    """By hand: b shares half of a's height and joins; c shares half of b's but not of a's, so it opens a row."""
    boxes = [(1, 1, 0, 0, 0, 10, 10), (1, 1, 1, 20, 5, 30, 15), (1, 1, 2, 40, 10, 50, 20), (1, 2, 3, 0, 0, 10, 10), (1, 3, 4, 5, 0, 5, 10), (1, 3, 5, 5, 50, 5, 60)]
    df = spark.createDataFrame(boxes, "section_id long, block_id long, region_id long, x0 long, y0 long, x1 long, y1 long")
    rows = lines.group_lines(df)
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [(1, 0, 0, 0, 30, 15, 2), (1, 2, 40, 10, 50, 20, 1), (2, 3, 0, 0, 10, 10, 1), (3, 4, 5, 0, 5, 10, 1), (3, 5, 5, 50, 5, 60, 1)]
    assert {r.block_id: r.align for r in lines.align(rows).collect()} == {1: "unknown", 2: "single", 3: "single"}


def test_alignment_by_hand(spark):
    rows = [(1, 1, i, 10, 20 * i, w, 20 * i + 10, 1) for i, w in enumerate((110, 80, 50))]
    rows += [(1, 2, i, 200 - w, 20 * i, 200, 20 * i + 10, 1) for i, w in enumerate((110, 80, 50))]
    rows += [(1, 3, i, 100 - w, 20 * i, 100 + w, 20 * i + 10, 1) for i, w in enumerate((50, 40, 20))]
    rows += [(1, 4, i, 0, 20 * i, 100 + w, 20 * i + 10, 1) for i, w in enumerate((0, 5))]
    df = spark.createDataFrame(rows, "section_id long, block_id long, row long, x0 long, y0 long, x1 long, y1 long, n long")
    assert {r.block_id: r.align for r in lines.align(df).collect()} == {1: "left", 2: "right", 3: "center", 4: "any"}


def test_no_regions_give_no_lines(spark):
    none = spark.createDataFrame([], REGIONS)
    for name in ("C4_merge_lines", "C5_merge_paragraphs", "C6_paragraph_blocks", "C9_units", "G5_group_lines", "G6_row_align"):
        assert run(spark, name, regions=none).count() == 0


def test_units_blocks_and_rows_leave_one_pass(spark):
    """Boxes are dealt by section for the gutters and for the fold; nothing is joined, and only boxes are written."""
    df = spark.createDataFrame(made(9, 8), REGIONS)
    for name, exchanges in (("C5_merge_paragraphs", 2), ("C6_paragraph_blocks", 2), ("C9_units", 2), ("G5_group_lines", 2), ("G6_row_align", 3)):
        plan = run(spark, name, regions=df)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") <= exchanges, (name, plan)
