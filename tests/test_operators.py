"""Operators against their SQL in DuckDB on the smallest tables, and small cases by hand."""

import pytest
from compare import connect, difference

from pagegrain import plans
from pagegrain.operators.match import e22_sql
from pagegrain.plans.dialect import DUCK
from pagegrain.plans.registry import bound, run

SF = "/root/testdata/sf0.001"
SOME = ["L2_tag_items", "L6_policy_counts", "C1_reading_order", "C8_classify_role", "C12_overlap_pairs", "C14_agreement", "E7_match_truth", "E21_count_delta", "B5_runs", "B22_keep_by_zone", "J5_parse_answers", "J9_cost_ledger", "I4_judge_agreement", "D7_build_truth"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_duckdb(spark, name):
    assert difference(plans.queries()[name](spark, SF), connect(SF), plans.oracles()[name]) is None


def regions(spark, rows):
    return spark.createDataFrame(rows, "section_id long, region_id long, x0 long, y0 long, x1 long, y1 long, text string, score double, line_no long")


def test_reading_order_by_bands_then_x(spark):
    r = regions(spark, [(1, 0, 50, 3, 60, 23, "b", 0.5, 0), (1, 1, 0, 5, 10, 25, "a", 0.5, 0), (1, 2, 0, 40, 10, 60, "c", 0.5, 0)])
    got = {x.region_id: x.pos for x in run(spark, "C1_reading_order", regions=r).collect()}
    assert got == {1: 0, 0: 1, 2: 2}


def test_overlap_pairs_need_more_than_a_border(spark):
    r = regions(spark, [(1, 0, 0, 0, 10, 10, "a", 0.5, 0), (1, 1, 5, 5, 15, 200, "b", 0.5, 0), (1, 2, 15, 0, 20, 10, "c", 0.5, 0)])
    assert [(x.a, x.b) for x in run(spark, "C12_overlap_pairs", regions=r).collect()] == [(0, 1)]


def test_no_cross_join_in_tagging(spark):
    plan = plans.queries()["L2_tag_items"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["L4_item_decision", "L10_score_items", "L11_prune_sections"])
def test_items_of_whole_texts(spark, tmp_path, name):
    """Patterns are looked for in whole texts, not in a row for each line; they stay within a line."""
    texts = ["ne\nver al ways the best", "N e\tv\rE r", "1 2\n3", "12 3 a@b1.", None, "", "bef ore\nx after", "before", "idi ot", "di sgusting SCUM", "@\nab.", "İ never @K9. \n\n always"]
    spark.createDataFrame([(k // 2 if k < 4 else k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 1), (1, 1, 0), (8, 0, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = plans.queries()[name](spark, str(tmp_path))
    assert "split(text" not in got._jdf.queryExecution().optimizedPlan().toString()
    blocks = "select doc_id as section_id, pos as block_id, line as text from documents lateral view posexplode(split(text, '\\n', -1)) s as pos, line"
    spark.read.parquet(f"{tmp_path}/documents.parquet").createOrReplaceTempView("documents")
    by_line = run(spark, name, str(tmp_path), blocks=spark.sql(blocks))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_line.collect()))
    assert name != "L4_item_decision" or got.count() > 5
    assert difference(plans.queries()[name](spark, SF), connect(SF), plans.oracles()[name]) is None


def test_tiles_are_counted_without_texts(spark):
    """Against the SQL, on tables and on odd boxes: repeated and missing ids, boxes above the page, without height or of many tiles."""
    got = plans.queries()["E22_tile_summary"](spark, SF)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert difference(got, connect(SF), plans.oracles()["E22_tile_summary"]) is None
    odd = [(s, r, 0, y0, 9, y1, "t", 0.5, 0) for s, r, y0, y1 in [(1, 0, 0, 900), (1, 0, 300, 320), (1, 1, -50, -20), (1, None, 140, 200), (2, 0, 139, 141), (2, 1, 5, 5), (3, 0, None, 60), (4, 0, 3, None), (None, 0, 0, 10), (5, 0, 0, 61), (6, 0, 0, 201), (6, 1, 139, 342), (6, 1, 0, 20)]]
    con = connect(SF)
    con.execute("create table odd (section_id bigint, region_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, text text, score double, line_no bigint)")
    con.executemany("insert into odd values (?,?,?,?,?,?,?,?,?)", odd)
    check = bound(e22_sql(DUCK), DUCK, {"regions": "odd"})
    assert difference(run(spark, "E22_tile_summary", regions=regions(spark, odd)), con, check) is None
