"""Dictionaries by name and the audits, by hand and against SQL written apart from them."""

import json

import pytest
from compare import connect, difference

from pagegrain import plans
from pagegrain.operators import audit
from pagegrain.sources.dictionaries import load_dict

SF = "/root/testdata/sf0.001"
CHECKED = ["A10_load_dictionary", "E1_text_key_any", "H12_policy_counts", "H16_residue", "H18_lost_and_parsed", "H22_ranked_targets", "H23_prefix_marks"]


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_duckdb(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.limit(1).count() == 1
    assert difference(df, connect(SF), plans.oracles()[name]) is None


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_keys_of_any_script(spark):
    df = spark.createDataFrame([(1, "Ａ-b_C 1"), (2, "É té ①½"), (3, None), (4, ""), (5, "a_B-9"), (6, "가 나.다")], "id long, t string")
    assert {r.id: r.key for r in audit.text_keys(df, "t").collect()} == {1: "abc1", 2: "été112", 3: None, 4: "", 5: "ab9", 6: "가나다"}


def test_forms_that_collide_or_lack(spark):
    rules = spark.createDataFrame([("x", "looks brighter"), ("y", "for firm skin"), ("z", None), ("", "a"), (None, "b"), ("w", "calm"), ("w", "calm")], "banned string, replacement string")
    forms = spark.createDataFrame([("x", "bright"), ("x", "brighter looks"), ("x", "look"), ("y", "skin for firm"), ("w", "calming"), ("w", None), ("v", "a")], "banned string, form string")
    assert rows(audit.form_collisions(rules, forms)) == {("x", "look", "looks brighter"), ("w", "calming", "calm")}
    assert rows(audit.missing_forms(rules, forms)) == {("z",)}


def test_policies(spark):
    pairs = [("a", "replaced"), ("a", "replaced"), ("a", "kept"), ("b", "kept"), ("c", None), ("d", "kept"), ("d", "replaced"), ("d", "open")]
    got = rows(audit.either_policy(spark.createDataFrame(pairs, "target string, how string")))
    assert got == {("a", 2, 1, "replacing"), ("b", 0, 1, "retaining"), ("c", 0, 0, "mixed"), ("d", 1, 1, "mixed")}


def test_residue_and_gate(spark):
    out = [(1, "a", "plain"), (2, "a", "name 미샤"), (3, "a", "미샤 크림"), (4, "a", "크림"), (1, "b", None), (2, "b", ""), (3, "b", "ok"), (3, "b", "ok"), (9, "b", "not expected")]
    out = spark.createDataFrame(out, "seg_id long, target string, translation string")
    exempt = spark.createDataFrame([(4,), (4,)], "seg_id long")
    left = audit.residual(out, keep=["미샤", ""], exempt=exempt)
    assert rows(left) == {(3, "a")}
    expected = spark.createDataFrame([(1,), (2,), (3,), (4,)], "seg_id long")
    answers = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 2, False), ("b", 1, None), ("c", 1, False)], "target string, doc_id long, parse_failed boolean")
    whole = audit.completeness(expected, out, answers)
    assert rows(whole) == {("a", 0, 2, 1, 0.5), ("b", 1, 1, 0, 1.0), ("c", 4, 1, 0, 1.0)}
    assert rows(audit.qualify(whole, left)) == {("a", 1, 0, 1, False), ("b", 0, 1, 0, False), ("c", 0, 4, 0, False)}
    fine = audit.completeness(expected.where("seg_id = 3"), out, answers.where("target = 'b'"))
    assert rows(audit.qualify(fine, left)) == {("b", 0, 0, 0, True)}
    tags = spark.createDataFrame([("a", "reference"), ("b", None)], "target string, tag string")
    assert {r.target for r in audit.ranked(whole, tags).collect()} == {"b", "c"}


def test_prefixes(spark):
    out = [(1, "a", "old old", "Renewed!", ""), (2, "a", "old", "x", "⚠️ kept"), (3, "a", "old", None, None), (4, "a", "new", "renew", ""), (5, "a", None, "renew", "")]
    df = spark.createDataFrame(out, "seg_id long, target string, source string, translation string, note string")
    assert rows(audit.prefix_check(df, [("old", "Renewing it"), ("new", " ")])) == {(1, "a", "old", "O"), (2, "a", "old", "-"), (3, "a", "old", "X"), (4, "a", "new", "X")}
    assert audit.prefix_check(df, []).count() == 0


def test_dictionaries_by_name(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(r) for r in ({"k": "a", "v": 1}, {"k": None, "v": 2}, {"k": "b", "v": 3})))
    (tmp_path / "two.csv").write_text('k,v\na,"x, ""y"""\na,z\n')
    spark.range(5).write.parquet(f"{root}/three.parquet")
    spark.range(5).write.parquet(f"{root}/one.parquet")
    assert rows(load_dict(spark, root, "two")) == {("a", 'x, "y"'), ("a", "z")}
    assert load_dict(spark, root, "three", ["id"]).count() == 5
    for name, key, most, what in (("one", [], 9, "several kinds"), ("none", [], 9, "no file"), ("two", ["k"], 9, "unique"), ("three", [], 4, "more than")):
        with pytest.raises(ValueError, match=what):
            load_dict(spark, root, name, key, most)
