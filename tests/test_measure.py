"""Wrapping and fitting, suppression, masks, and stages on disk, against plain restatements and by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import measure, suppress
from pagegrain.operators.measure import Fit
from pagegrain.plans.registry import run
from pagegrain.sources import stages

SEGMENTS = "seg_id long, target string, box_w long, box_h long, src_lines int"


def width(text):
    return sum(measure.GLYPHS.get(c, measure.GLYPH) for c in text)


def wrapped(text, box, px):
    """Number of lines, by joining words as text and measuring the line again."""
    lines, now = 1, None
    for w in text.split():
        if width(w) * px > box * 1000:
            return None
        if now is not None and width(now + " " + w) * px > box * 1000:
            lines, now = lines + 1, w
        else:
            now = w if now is None else now + " " + w
    return lines


def measured(text, w, h, n, cfg):
    text, n = text or "", max(1, n or 1)
    em = max(1, round(h / n * 1.35))

    def height(scale):
        px = max(1, round(em * scale))
        k = wrapped(text, w, px)
        return None if k is None else k * px * 1.2

    def fits(scale, wrap, grow):
        if not wrap:
            return width(text) * max(1, round(em * scale)) <= w * 1000
        return height(scale) is not None and height(scale) <= h * grow + 1

    grown = [None if height(s) is None else height(s) / max(1, h) for s in (1.0, 0.8)]
    return em, next((s for s in cfg.shrink if fits(s, cfg.wrap, cfg.grow)), None), next((s for s in measure.NEED if fits(s, True, 1.0)), None), *grown


def segments(seed=1, n=150):
    rng = random.Random(seed)
    words = ["will", "mammoth", "a", "text", "of", "overwhelmingly", "i.", "W"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice((0, 10, 40, 80, 160)), rng.choice((0, 5, 13, 20, 40)), rng.choice((None, 0, 1, 2, 3))) for i in range(n)]
    return rows + [(900, None, 50, 20, 1), (901, "  two\n\twords ", 50, 20, 1)]


@pytest.mark.parametrize("cfg", [Fit(), Fit(wrap=False, shrink=(1.0,)), Fit(shrink=(1.0,), grow=1.5)])
def test_measures_as_restated(spark, cfg):
    rows = segments()
    got = {r.seg_id: r for r in measure.measure(spark.createDataFrame(rows, SEGMENTS), cfg).collect()}
    assert len(got) == len(rows)
    for i, text, w, h, n in rows:
        em, fit, need, g100, g80 = measured(text, w, h, n, cfg)
        r = got[i]
        assert (r.em, r.fit_scale, r.need_scale, r.overflow) == (em, fit, need, fit is None), (text, w, h, n)
        for a, b in ((r.need_grow, g100), (r.need_grow_80, g80)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 0.00501)


def test_wrapped_lines_by_hand(spark):
    df = spark.createDataFrame([(1, "aa bb cc", 100), (2, "", 5), (3, "aaaa", 20), (4, "a a", 14), (5, "a a", 13)], "seg_id long, target string, box_w long")
    got = {r.seg_id: r.lines for r in run(spark, "K4_wrap_lines", boxed=df, px=10, glyphs={}).collect()}
    # a letter is 5.5 wide, and so is a blank here: 44, none, 22 in 20, 16.5 in 14, 16.5 in 13
    assert got == {1: 1, 2: 1, 3: None, 4: 2, 5: 2}


def test_share_by_em(spark):
    df = spark.createDataFrame(segments(2), SEGMENTS)
    small, large = run(spark, "K11_em_assumption", boxed=df, ems=(0.9, 1.35)).orderBy("em").collect()
    assert small.scale_80 >= large.scale_80 and small.grow_2 >= large.grow_2 and 0 < large.scale_50 < 1


def test_texts_are_measured_once_for_all_ratios_and_scales(spark):
    df = spark.createDataFrame(segments(3) + [(950, "word " * 3000, 30, 40, 1), (951, "\u00fc\U0001f600 i" * 40, 60, 400, 2), (952, "two words", None, 20, 1), (953, "two words", 50, None, 1), (954, "", None, None, None)], SEGMENTS)
    ems = (0.9, 1.35, 3.0)
    shares = run(spark, "K11_em_assumption", boxed=df, ems=ems)
    plan = shares._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan
    n = df.count()
    for r in shares.collect():
        m = measure.measure(df, em_ratio=r.em).collect()
        assert r.scale_80 == round(sum((x.need_scale or 0) >= 0.8 for x in m) / n, 6)
        assert r.grow_3 == round(sum(x.need_grow is not None and x.need_grow <= 3 for x in m) / n, 6)
    long = measure.measure(df.where("seg_id = 950")).collect()[0]
    em, _, need, grow, _ = measured("word " * 3000, 30, 40, 1, Fit())
    assert (long.em, long.need_scale, long.need_grow) == (em, need, grow and pytest.approx(grow, abs=0.00501))
    none = {r.seg_id: (r.need_scale, r.need_grow) for r in measure.measure(df.where("seg_id > 951")).collect()}
    assert none == {952: (None, None), 953: (None, 1.2), 954: (None, 1.2)}


def overlap(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u else 0.0


def test_suppression_as_restated(spark):
    """Chains of ever worse neighbours, equal scores, equal boxes, boxes over several bands and without area."""
    rng = random.Random(6)
    rows = [(g, i, x := rng.randrange(0, 100, 10), y := rng.randrange(0, 900, 30), x + rng.choice((0, 30, 60)), y + rng.choice((30, 400)), rng.choice((0.1, 0.5, 0.5, 0.9, None))) for g in range(5) for i in range(60)]
    rows += [(9, i, 0, 8 * i, 20, 8 * i + 20, 1 - i / 100) for i in range(30)]
    want = set()
    for g in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[6] or 0.0), r[1])):
            if all(overlap(r[2:6], k[2:6]) < 0.3 for k in kept):
                kept.append(r)
                want.add(r[:2])
    d = suppress.nms(spark.createDataFrame(rows, "group_id long, det_id long, x0 long, y0 long, x1 long, y1 long, score double"))
    assert d.count() == len(rows)
    assert {tuple(r) for r in d.where("kept").select("group_id", "det_id").collect()} == want


def test_mask_agreement_by_hand(spark):
    """Row 0: raw 0-100, other 50-150, text 80-100, raw twice over itself; section 2 has text alone, section 3 no overlap."""
    rows = [(1, "raw", 0, 0, 60), (1, "raw", 0, 40, 100), (1, "other", 0, 50, 150), (1, "text", 0, 80, 100), (2, "text", 5, 0, 9), (3, "raw", 0, 0, 10), (3, "other", 1, 0, 10)]
    got = {r.section_id: (r.iou, r.erased_pct, r.differs, r.eats_foreground) for r in run(spark, "M8_mask_agreement", mask_runs=spark.createDataFrame(rows, "section_id long, mask string, y long, x0 long, x1 long")).collect()}
    assert got == {1: (round(30 / 130, 6), 20.0, True, True), 2: (1.0, 0.0, False, False), 3: (0.0, 0.0, True, False)}


def stage(spark, rows):
    return spark.createDataFrame(rows, "section_id long, v long")


def test_whole_and_partial_runs(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    read = lambda v=None: sorted((r.variant, r.section_id, r.v) for r in stages.read_stage(spark, root, "blocks", v).collect())
    figures = lambda: {r.variant: (r.units, r.n_rows) for r in stages.read_metrics(spark, root).collect()}
    stages.write_stage(stage(spark, [(i, i) for i in range(100)]), root, "blocks", "a")
    stages.write_stage(stage(spark, [(1, 7), (1, 8)]), root, "blocks", "b")
    assert figures() == {"a": (100, 100), "b": (1, 2)}
    stages.write_stage(stage(spark, [(3, 33), (3, 34), (200, 1)]), root, "blocks", "a", partial=True)
    assert read("a") == sorted([("a", i, i) for i in range(100) if i != 3] + [("a", 3, 33), ("a", 3, 34), ("a", 200, 1)])
    assert read("b") == [("b", 1, 7), ("b", 1, 8)] and figures() == {"a": (100, 100), "b": (1, 2)}
    stages.write_stage(stage(spark, [(5, 5)]), root, "blocks", "a")
    assert read("a") == [("a", 5, 5)] and figures() == {"a": (1, 1), "b": (1, 2)}
    with pytest.raises(ValueError):
        stages.write_stage(stage(spark, [(5, 5)]).withColumn("variant", F.lit(1)), root, "blocks", "a")


def test_a_run_that_dies_half_way_leaves_what_was_there(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    stages.write_stage(stage(spark, [(i, i) for i in range(50)]), root, "blocks", "a")
    bad = stage(spark, [(i, i) for i in range(50)]).repartition(4).withColumn("v", F.when(F.col("section_id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1))
    for partial in (False, True):
        with pytest.raises(Exception, match="lost"):
            stages.write_stage(bad, root, "blocks", "a", partial=partial)
        assert sorted(r.v for r in stages.read_stage(spark, root, "blocks", "a").collect()) == list(range(50))
        assert [tuple(r)[:2] for r in stages.read_metrics(spark, root).select("units", "n_rows").collect()] == [(50, 50)]


def test_folders_of_translations(spark, tmp_path):
    def put(path, text):
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)

    put("one/b.json", '{"doc_id": "b", "translations": [{"id": "s1", "translation": "x", "note": "n"}, {"id": "s2"}]}')
    put("one/deeper/c.json", '{"translations": [{"id": "no"}]}')
    put("two/m 1+x/d.json", '{"translations": [{"id": "s1", "translation": "y"}], "parse_error": true}')
    put("two/m2/e.json", "{broken")
    put("two/m2/sub/f.json", '{"translations": [{"id": "no"}]}')
    put("three/readme.txt", "no")
    put("top.json", '{"translations": [{"id": "no"}]}')
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = sorted((r.label, r.file, r.id or "", r.translation, r.note, r.parse_failed) for r in stages.read_translations(spark, root).collect())
        assert got == [("one", "one/b.json", "s1", "x", "n", False), ("one", "one/b.json", "s2", None, None, False), ("two/m 1+x", "two/m 1+x/d.json", "s1", "y", None, True), ("two/m2", "two/m2/e.json", "", None, None, True)]


def test_masks_are_swept_as_boxes(spark, monkeypatch):
    """Areas pixel by pixel, with sections that come in several parts; only packed boxes are shuffled."""
    monkeypatch.setattr(suppress, "SWEPT", 7)
    rng, rows = random.Random(8), []
    for s in (None, -3, 0, 5, 6):
        for _ in range(40):
            x, y = rng.randrange(40), rng.randrange(0, 300)
            w, mask = rng.choice((0, 3, 12)), rng.choice(("raw", "raw", "other", "other", "text", "else"))
            rows += [(s, mask, k, x, x + w) for k in range(y, y + rng.choice((1, 4, 9)))]
    rows += [(7, "else", 1, 0, 5), (8, "raw", 1, 5, 5)]
    df = spark.createDataFrame(rows, "section_id long, mask string, y long, x0 long, x1 long")
    out = run(spark, "M8_mask_agreement", mask_runs=df)
    want = {}
    for s in {r[0] for r in rows}:
        raw, other, text = ({(r[2], x) for r in rows if r[0] == s and r[1] == m for x in range(r[3], r[4])} for m in suppress.MASKS)
        u = (raw | other) - text
        iou, erased = len((raw & other) - text) / len(u) if u else 1.0, 100 * len(raw & text) / len(raw) if raw else 0.0
        want[s] = (pytest.approx(iou, abs=1e-6), pytest.approx(erased, abs=1e-4), iou < 0.8, erased > 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 2
    assert {r.section_id: (r.iou, r.erased_pct, r.differs, r.eats_foreground) for r in out.collect()} == want
