"""Tile plans, carried verdicts and the gate, by hand and against plain restatements."""

import pytest

from pagegrain.operators import reports
from pagegrain.plans.registry import run


def plain_tiles(mode, h, w, size, overlap):
    if mode == "whole":
        spans = [(0, h)]
    elif mode == "square":
        spans = [(0, h)] if h <= w else [(t, t + w) for t in sorted({*range(0, h - w, max(1, w - overlap)), h - w})]
    else:
        step = size if mode == "bands" else size - overlap
        spans = [(t, min(h, t + size)) for t in range(0, h if mode == "bands" else max(1, h - overlap), step)]
    half, last = (overlap // 2 if mode == "overlap" else 0), len(spans) - 1
    return [(i, a, b, a + (half if i else 0), b - (half if i < last else 0)) for i, (a, b) in enumerate(spans)]


@pytest.mark.parametrize("mode", reports.MODES)
def test_tiles_as_restated(spark, mode):
    pages = [(i, h, w) for i, (h, w) in enumerate((h, w) for h in (1, 59, 60, 61, 200, 201, 339, 340, 341, 1000) for w in (10, 100, 339))]
    df = spark.createDataFrame([*pages, (99, 0, 10)], "page_id long, h long, w long")
    got = {}
    for r in reports.tile_plan(df, mode, 200, 60).collect():
        got.setdefault(r.page_id, []).append(tuple(r)[1:])
    assert {p: sorted(t) for p, t in got.items()} == {p: plain_tiles(mode, h, w, 200, 60) for p, h, w in pages}
    with pytest.raises(ValueError):
        reports.tile_plan(df, mode, 10, 10)


def test_verdicts_go_to_equal_variants_only(spark):
    blocks = [(1, v, p) for v in "abc" for p in "xy"] + [(1, "d", "x"), (2, "a", "x"), (2, "b", "x"), (2, "b", "x"), (2, "c", "x"), (3, "a", "q"), (3, "b", "q")]
    given = [(1, "b", "B"), (1, "d", "A"), (2, "a", "A"), (2, "b", "C"), (3, "a", None)]
    f = spark.createDataFrame
    got = {tuple(r) for r in run(spark, "C16_verdicts_with_conflicts", unit_parts=f(blocks, "unit_id long, variant string, part string"), verdicts_given=f(given, "unit_id long, variant string, verdict string")).collect()}
    assert got == {(1, "b", "B", "own"), (1, "a", "B", "b"), (1, "c", "B", "b"), (1, "d", "A", "own"), (2, "a", "A", "conflict"), (2, "b", "C", "conflict")}


def test_gate_looks_at_missed_and_false(spark):
    f = lambda rows: spark.createDataFrame(rows, "key long, state string")
    now = [(1, "found"), (1, "missed"), (2, "false"), (3, "found"), (4, "missed")]
    was = [(1, "missed"), (1, "missed"), (2, "found"), (3, "false")]
    got = {r.key: r.passed for r in run(spark, "E8_gate_missed_and_false", states_now=f(now), states_before=f(was)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
