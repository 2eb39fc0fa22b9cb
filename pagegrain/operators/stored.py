"""Stages on disk as operators: written, partly replaced, and read back; the audit of an evaluation set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.plans.registry import frame, view
from pagegrain.sources import stages
from pagegrain.sources.scratch import new_path

PHRASES = ("the ", " with ", "er.", "for ", "never said")
PHRASES_MOST = 10_000


@frame("A8_write_stage", "blocks", "blocks_b", check=lambda d: """select variant, count(distinct section_id) as units, count(*) as n_rows from
    (select 'a' as variant, section_id from blocks union all select 'b' as variant, section_id from blocks_b) q group by variant""")
def a8(blocks: DataFrame, other: DataFrame, root: str | None = None) -> DataFrame:
    """Two variants of a stage and the figures of their whole runs."""
    spark, root = blocks.sparkSession, root or new_path(blocks.sparkSession, "stages")
    stages.write_stage(blocks, root, "blocks", "a")
    stages.write_stage(other, root, "blocks", "b")
    return stages.read_metrics(spark, root).select("variant", "units", "n_rows")


@frame("A9_write_partial", "blocks", "blocks_b", check=lambda d: """select section_id, block_id, again from (select section_id, block_id, false as again from blocks where section_id not in
    (select l.section_id from blocks l join blocks_b b on l.section_id = b.section_id where l.is_label) union all
    select section_id, block_id, true as again from blocks_b where section_id in (select section_id from blocks where is_label)) q""")
def a9(blocks: DataFrame, other: DataFrame, root: str | None = None) -> DataFrame:
    """A whole run, then a partial one over the sections that have a label; those without a row in it keep their old ones."""
    spark, root = blocks.sparkSession, root or new_path(blocks.sparkSession, "stages")
    stages.write_stage(blocks.withColumn("again", F.lit(False)), root, "blocks", "a")
    labelled = blocks.where("is_label").select("section_id").distinct()
    stages.write_stage(other.join(labelled, "section_id", "left_semi").withColumn("again", F.lit(True)).select(*blocks.columns, "again"), root, "blocks", "a", partial=True)
    return stages.read_stage(spark, root, "blocks", "a").select("section_id", "block_id", "again")


@frame("A5_read_translations", "segments", check=lambda d: """select case target when 'a' then 'first' else 'second/run' end as label, cast(seg_id as varchar(20)) as id, translation, false as parse_failed from segments""")
def a5(segments: DataFrame, root: str | None = None) -> DataFrame:
    """Answers of two runs in folders of one and two levels, read back by folder."""
    spark, root = segments.sparkSession, root or new_path(segments.sparkSession, "answers")
    one = F.struct(F.col("seg_id").cast("string").alias("id"), "translation")
    files = segments.groupBy("target", F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_list(one).alias("translations"))
    for target, folder in (("a", "first"), ("b", "second/run")):
        files.where(F.col("target") == target).drop("target").write.json(f"{root}/{folder}", ignoreNullFields=False)
    return stages.read_translations(spark, root, lines=True).select("label", "id", "translation", "parse_failed")


@view
def evalset(d):
    return "select seg_id, source from segments where target = 'a'"


@view
def traps(d):
    """Marked segments, and marks whose segment is not in the set."""
    return """select seg_id, case when length(source) % 2 = 0 then 'context' else 'quote' end as kind, case when length(source) % 3 = 0 then 'replace' else 'keep' end as expected from segments
        where target = 'a' and length(source) % 5 = 0 union all select -1 - doc_id as seg_id, 'gone' as kind, 'keep' as expected from documents where n_chars % 50 = 0"""


def _audit(d):
    rows = ", ".join(f"('{p}')" for p in PHRASES)
    return f"""with b as (select * from (values {rows}) v(phrase)), hits as (select seg_id, phrase from evalset join b on contains(source, phrase))
        select 'pair' as part, coalesce(kind, 'control') as kind, coalesce(expected, 'replace') as expected, '' as item, count(*) as n from hits left join traps using (seg_id) group by all
        union all select 'unused', '', '', phrase, 0 from b where phrase not in (select phrase from hits)
        union all select 'orphan', kind, expected, cast(seg_id as varchar), 0 from traps where seg_id not in (select seg_id from evalset)
        union all select 'silent', kind, expected, cast(seg_id as varchar), 0 from traps where seg_id not in (select seg_id from hits)"""


@frame("H2_audit_traps", "evalset", "traps", check=_audit)
def h2(evalset: DataFrame, traps: DataFrame, banned: Sequence[str] = PHRASES) -> DataFrame:
    """part, kind, expected, item, n: how an evaluation set's traps are made up.

    pair: segments and the banned phrases in them, by the trap's kind and what is expected (without a trap: control, replace);
    unused: phrases in no segment; orphan: traps whose segment is not in the set; silent: traps without a phrase in their segment.
    The phrases are a dictionary of at most ``PHRASES_MOST``, looked up inside the row.
    """
    if len(banned) > PHRASES_MOST:
        raise ValueError(f"at most {PHRASES_MOST} phrases")
    spark = evalset.sparkSession
    found = F.filter(F.array(*map(F.lit, banned)), lambda b: F.contains(F.col("source"), b)) if banned else F.array().cast("array<string>")
    hits = evalset.select("seg_id", F.explode(found).alias("phrase"))
    pair = hits.join(traps, "seg_id", "left").groupBy(F.coalesce("kind", F.lit("control")).alias("kind"), F.coalesce("expected", F.lit("replace")).alias("expected")).agg(F.count(F.lit(1)).alias("n"))
    none = lambda d, part, item: d.select(F.lit(part).alias("part"), "kind", "expected", item.cast("string").alias("item"), F.lit(0).cast("bigint").alias("n"))
    unused = spark.createDataFrame([(b, "", "") for b in banned], "phrase string, kind string, expected string").join(hits.select("phrase").distinct(), "phrase", "left_anti")
    out = pair.select(F.lit("pair").alias("part"), "kind", "expected", F.lit("").alias("item"), "n").union(none(unused, "unused", F.col("phrase")))
    out = out.union(none(traps.join(evalset, "seg_id", "left_anti"), "orphan", F.col("seg_id")))
    return out.union(none(traps.join(hits.select("seg_id").distinct(), "seg_id", "left_anti"), "silent", F.col("seg_id")))
