"""Audits of dictionaries and outputs: keys of texts, colliding forms, policies, residue, completeness, the gate of a target."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagegrain.operators.terms import _bounded, has_phrase, joined
from pagegrain.plans.registry import frame, view
from pagegrain.sources.dictionaries import load_dict
from pagegrain.sources.scratch import new_path

NOT_WORD = re.compile(r"[\W_]+")


@F.pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    """Compatibility forms composed; Spark has no function for it."""
    return text.map(lambda t: None if t is None else NOT_WORD.sub("", unicodedata.normalize("NFKC", t).lower()))


def text_keys(rows: DataFrame, text: str, out: str = "key") -> DataFrame:
    """``rows`` with the key of a text: compatibility forms composed, lower case, letters and digits of any script only. Null stays null.

    Plain ASCII texts take an expression; only the others reach Python.
    """
    plain = F.coalesce(~F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(True))
    native = rows.where(plain).withColumn(out, F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""))
    return native.union(rows.where(~plain).withColumn(out, _folded(text)))


def form_collisions(rules: DataFrame, forms: DataFrame) -> DataFrame:
    """banned, form, replacement where a literal form of a phrase holds its replacement or the reverse, by stems: such a form
    cannot tell a replaced phrase from a kept one.

    ``rules``: banned, replacement; ``forms``: banned, form. Nulls and phrases without a word collide with nothing.
    """
    d = rules.where("replacement is not null").join(forms.where("form is not null"), "banned")
    hit = has_phrase(joined(F.col("replacement")), F.col("form")) | has_phrase(joined(F.col("form")), F.col("replacement"))
    return d.where(hit).select("banned", "form", "replacement").distinct()


def missing_forms(rules: DataFrame, forms: DataFrame) -> DataFrame:
    """Banned phrases (not null, not empty) without a row in ``forms``: their check is half a check."""
    return rules.where("banned <> ''").select("banned").distinct().join(forms.select("banned"), "banned", "left_anti")


def either_policy(pairs: DataFrame) -> DataFrame:
    """target, replaced, kept and policy over pairs where both are right: whichever is more frequent, else mixed.

    ``pairs``: target, how (``replaced``, ``kept``; anything else counts for neither).
    """
    n = pairs.groupBy("target").agg(F.count_if(F.col("how") == "replaced").alias("replaced"), F.count_if(F.col("how") == "kept").alias("kept"))
    return n.withColumn("policy", F.when(F.col("replaced") > F.col("kept"), "replacing").when(F.col("kept") > F.col("replaced"), "retaining").otherwise("mixed"))


def residual(outputs: DataFrame, script: str = r"\p{IsHangul}", keep: Sequence[str] = (), exempt: DataFrame | None = None) -> DataFrame:
    """seg_id, target of outputs in which letters of the source's script are left once the words of ``keep`` are taken out, in their order.

    ``exempt`` (seg_id): segments where the source's words are right. Without an output there is no residue.
    """
    d = outputs.where("translation is not null")
    if exempt is not None:
        d = d.join(exempt.select("seg_id"), "seg_id", "left_anti")
    t = F.col("translation")
    for word in _bounded(keep):
        t = F.replace(t, F.lit(word), F.lit("")) if word else t
    return d.where(t.rlike(script)).select("seg_id", "target")


def completeness(expected: DataFrame, outputs: DataFrame, answers: DataFrame) -> DataFrame:
    """target, lost, docs, parse_failed, rate: segments without an output row, and the share of a target's documents that parsed.

    ``expected``: seg_id; ``outputs``: seg_id, target (a row with an empty or null text is there); ``answers``: target, doc_id, parse_failed.
    Every target with answers is listed; its segments are counted, not paired with all targets.
    """
    n = expected.select("seg_id").distinct().agg(F.count(F.lit(1)).alias("segments"), F.lit(1).alias("one"))
    have = outputs.select("seg_id", "target").distinct().join(expected.select("seg_id"), "seg_id", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("have"))
    docs = answers.groupBy("target", "doc_id").agg(F.max(F.coalesce("parse_failed", F.lit(False))).alias("bad"))
    docs = docs.groupBy("target").agg(F.count(F.lit(1)).alias("docs"), F.count_if("bad").alias("parse_failed"))
    d = docs.join(have, "target", "left").withColumn("one", F.lit(1)).join(F.broadcast(n), "one")  # one row
    lost = F.col("segments") - F.coalesce("have", F.lit(0))
    return d.select("target", lost.alias("lost"), "docs", "parse_failed", F.bround(1 - F.col("parse_failed") / F.col("docs"), 6).alias("rate"))


def qualify(complete: DataFrame, residue: DataFrame) -> DataFrame:
    """target, parse_failed, lost, residue, qualified: a target passes only with none of the three."""
    left = residue.groupBy("target").agg(F.count(F.lit(1)).alias("residue"))
    d = complete.join(left, "target", "left").select("target", "parse_failed", "lost", F.coalesce("residue", F.lit(0)).cast("bigint").alias("residue"))
    return d.withColumn("qualified", (F.col("parse_failed") == 0) & (F.col("lost") == 0) & (F.col("residue") == 0))


def ranked(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of the targets that no tag keeps out of a ranking. ``tags``: target, tag; null tags keep nobody out."""
    return rows.join(tags.where("tag is not null").select("target"), "target", "left_anti")


def prefix_check(outputs: DataFrame, rules: Sequence[tuple[str, str]], marks: str = "⚠") -> DataFrame:
    """seg_id, target, banned, mark: O if the first five characters of the replacement's first word are in the output, - if the note
    begins with a warning mark, else X. For comparison with whole-phrase verdicts: it finds too much.

    ``outputs``: seg_id, target, source, translation, note; ``rules``: banned phrase and replacement; a replacement without a word is never there.
    """
    text = F.lower(F.coalesce("translation", F.lit("")))
    each = []
    for banned, by in _bounded(rules):
        first = (by.split() or [""])[0].lower()[:5]
        there = F.contains(text, F.lit(first)) if first else F.lit(False)
        mark = F.when(there, "O").when(F.coalesce(F.startswith("note", F.lit(marks)), F.lit(False)), "-").otherwise("X")
        each.append(F.when(F.contains("source", F.lit(banned)), F.struct(F.lit(banned).alias("banned"), mark.alias("mark"))))
    found = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<banned:string,mark:string>>")
    return outputs.select("seg_id", "target", F.explode(found).alias("f")).select("seg_id", "target", "f.banned", "f.mark")


@view
def wordings(d):
    """A rule for each part: what it is called, and by which name."""
    return "select cast(p_partkey as varchar(20)) as banned, p_name as replacement from part"


@view
def literal_forms(d):
    """Forms of most parts: their kind, and for some the last word of their name with an ending."""
    return f"""select cast(p_partkey as varchar(20)) as banned, lower(p_type) as form from part where p_size % 9 <> 0
        union all select cast(p_partkey as varchar(20)) as banned, concat({d.extract('p_name', '[a-z]+$')}, 's') as form from part where p_size % 5 = 0"""


@view
def either_pairs(d):
    return """select seg_id, target, case when t like '% pro %' and not t like '% for %' then 'replaced' when t like '% for %' and not t like '% pro %' then 'kept' end as how
        from outputs where s like '% for %' and translation is not null"""


@view
def answer_docs(d):
    return "select distinct doc_id, target, target = 'b' and doc_id % 50 = 7 as parse_failed from segments"


@view
def out_rows(d):
    return "select seg_id, target, source, translation, case when line_no % 4 = 0 then '⚠ left on purpose' else '' end as note from segments where translation is not null"


@view
def exempted(d):
    return "select distinct seg_id from segments where length(source) % 7 = 0"


@view
def target_tags(d):
    """Targets that are there for comparison only."""
    return "select distinct target, case when target = 'b' then 'reference' end as tag from segments"


@frame("A10_load_dictionary", "brands", check=lambda d: "select brand, brand_key from brands")
def a10(brands: DataFrame, root: str | None = None) -> DataFrame:
    """The brands written as a dictionary of the shared folder, and loaded by name."""
    spark, root = brands.sparkSession, root or new_path(brands.sparkSession, "dictionaries")
    brands.coalesce(1).write.json(f"{root}/brands.jsonl", ignoreNullFields=False)
    return load_dict(spark, root, "brands", ["brand"]).select("brand", "brand_key")


@frame("E1_text_key_any", "documents", check=lambda d: """select doc_id, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g')) as key_sha from documents""")
def e1(documents: DataFrame) -> DataFrame:
    return text_keys(documents.select("doc_id", "text"), "text").select("doc_id", F.sha2("key", 256).alias("key_sha"))


@frame("H6_forms_audit", "wordings", "literal_forms")
def h6(rules: DataFrame, forms: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return form_collisions(rules, forms).select(F.lit("collides").alias("fault"), "banned", "form").union(missing_forms(rules, forms).select(F.lit("missing"), "banned", none))


@frame("H12_policy_counts", "either_pairs", check=lambda d: """select target, sum((how = 'replaced')::int)::bigint as replaced, sum((how = 'kept')::int)::bigint as kept, case sign(sum(case how when 'replaced' then 1 when 'kept' then -1 else 0 end))
    when 1 then 'replacing' when -1 then 'retaining' else 'mixed' end as policy from (select target, coalesce(how, '') as how from either_pairs) q group by target""")
def h12(pairs: DataFrame) -> DataFrame:
    return either_policy(pairs)


SCRIPT, KEEP = "[äöüßçéèñ]", ("schö", "é", "für ")


@frame("H16_residue", "out_rows", "exempted", check=lambda d: f"""select seg_id, target from out_rows where seg_id not in (select seg_id from exempted)
    and regexp_matches(replace(replace(replace(translation, '{KEEP[0]}', ''), '{KEEP[1]}', ''), '{KEEP[2]}', ''), '{SCRIPT}')""")
def h16(outputs: DataFrame, exempt: DataFrame, script: str = SCRIPT, keep: Sequence[str] = KEEP) -> DataFrame:
    return residual(outputs, script, keep, exempt)


COMPLETE = """select target, (select count(*) from evalset) - count(distinct o.seg_id) as lost, count(distinct a.doc_id) as docs, count(distinct case when a.parse_failed then a.doc_id end) as parse_failed,
    round(1 - count(distinct case when a.parse_failed then a.doc_id end) / count(distinct a.doc_id), 6) as rate from answer_docs a left join (select seg_id, target, seg_id // 100000 as doc_id from out_rows) o using (doc_id, target) group by target"""


@frame("H18_lost_and_parsed", "evalset", "out_rows", "answer_docs", check=lambda d: COMPLETE)
def h18(expected: DataFrame, outputs: DataFrame, answers: DataFrame) -> DataFrame:
    return completeness(expected, outputs, answers)


@frame("H19_qualify_gate", "evalset", "out_rows", "answer_docs", "exempted", "target_tags")
def h19(expected: DataFrame, outputs: DataFrame, answers: DataFrame, exempt: DataFrame, tags: DataFrame, script: str = SCRIPT, keep: Sequence[str] = KEEP) -> DataFrame:
    """The gate of every target, and whether it is ranked at all."""
    gate = qualify(completeness(expected, outputs, answers), residual(outputs, script, keep, exempt))
    return gate.join(ranked(gate.select("target"), tags).withColumn("ranked", F.lit(True)), "target", "left").fillna(False, ["ranked"])


@frame("H22_ranked_targets", "out_rows", "target_tags", check=lambda d: "select target, count(*) as n from out_rows where target in (select target from target_tags where tag is null) group by target")
def h22(rows: DataFrame, tags: DataFrame) -> DataFrame:
    return ranked(rows, tags).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


LEGACY = (("the", "that one"), ("with", "Alongside it"), ("for", "pro"))


@frame("H23_prefix_marks", "out_rows", check=lambda d: " union all ".join(f"""select seg_id, target, '{b}' as banned, case when contains(lower(translation), '{p}') then 'O' when starts_with(note, '⚠') then '-' else 'X' end as mark
    from out_rows where contains(source, '{b}')""" for b, p in (("the", "that"), ("with", "along"), ("for", "pro"))))
def h23(outputs: DataFrame, rules: Sequence[tuple[str, str]] = LEGACY) -> DataFrame:
    return prefix_check(outputs, rules)
