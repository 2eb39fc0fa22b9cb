"""Texts against the caller's dictionaries: phrases by word stems, term tables, numbers, keyword tags.

A dictionary is a sequence in the driver, of at most ``ENTRIES`` entries, and becomes literals of one
projection: texts are read once, whatever its length. Term tables that grow with the data are joined by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.plans.registry import frame, view

ENTRIES = 10_000
WIDE, ASCII = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
ENDINGS = ("ing", "ed", "es", "s")


def _bounded(entries: Sequence) -> Sequence:
    if len(entries) > ENTRIES:
        raise ValueError(f"a dictionary has at most {ENTRIES} entries")
    return entries


def normal(text: Column) -> Column:
    """Lower case, wide forms as ASCII, hyphens, slashes and signs as blanks; letters, digits and % stay."""
    t = F.coalesce(text, F.lit(""))
    t = F.lower(F.when(t.rlike("[\uff01-\uff5e]"), F.translate(t, WIDE, ASCII)).otherwise(t))
    return F.regexp_replace(F.regexp_replace(t, "[-–—_/]", " "), r"[^\p{L}\p{M}0-9%\s]", " ")


def _cut(text: Column) -> Column:
    # of endings that fit, the longest, as it leaves the shortest stem
    cut = F.regexp_replace(text, rf"(?<!\S)([a-z]{{3,}}?)(?:{'|'.join(ENDINGS)})(?!\S)", "$1")
    return F.regexp_replace(cut, r"(?<!\S)([a-z]{3,})e(?!\S)", "$1")


def stem(word: Column) -> Column:
    """A word of ASCII letters without its ending (three letters must stay), then without a last e if longer than three."""
    return F.when(word.rlike("^[a-z]+$"), _cut(word)).otherwise(word)


def stemmed(text: Column) -> Column:
    """Normal text with the stems of its words: patterns over the whole text, not a step for each word."""
    return _cut(normal(text))


def stems(text: Column) -> Column:
    return F.filter(F.split(stemmed(text), r"\s+"), lambda w: w != "")


def joined(text: Column) -> Column:
    """Stems of a text with a mark on both sides of each, so that a run of stems is a part of the text."""
    return F.concat(F.lit("\x01"), F.regexp_replace(F.regexp_replace(stemmed(text), r"^\s+|\s+$", ""), r"\s+", "\x01"), F.lit("\x01"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether ``joined`` stems hold the stems of a phrase in a row; one or two first ones may be missing if three remain.

    A phrase without a word is never there.
    """
    p = joined(phrase)
    parts = F.split(p, "\x01")  # an empty one at both ends
    test = (p != "\x01\x01") & F.contains(text, p)
    for i in (1, 2):
        rest = F.concat(F.lit("\x01"), F.array_join(F.slice(parts, i + 2, F.size(parts)), "\x01"))
        test |= (F.size(parts) - 2 - i >= 3) & F.contains(text, rest)
    return F.coalesce(test, F.lit(False))


def phrase_hits(texts: DataFrame, phrases: Sequence[str], key: str = "seg_id", text: str = "translation") -> DataFrame:
    """``key`` and phrase for each phrase of the dictionary that a text has."""
    t = texts.select(key, joined(F.col(text)).alias("t"))
    tests = [F.when(has_phrase(F.col("t"), F.lit(p)), F.lit(p)) for p in _bounded(phrases)]
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
    return t.select(key, F.explode(found).alias("phrase"))


def term_accuracy(outputs: DataFrame, terms: DataFrame) -> DataFrame:
    """target, ok, total over the terms of each segment that a target has: ``outputs`` seg_id, target, translation; ``terms``
    seg_id, term, where a bar parts forms of which one is enough. Null translations count as absent."""
    t = outputs.where("translation is not null").select("seg_id", "target", joined(F.col("translation")).alias("t"))
    d = t.join(terms.select("seg_id", "term").where("term is not null"), "seg_id")
    ok = F.exists(F.split("term", "[|]"), lambda form: has_phrase(F.col("t"), form))
    return d.groupBy("target").agg(F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("total"))


def numbers_of(text: Column, suffix: str = "월", strip: Sequence[str] = ()) -> Column:
    """Number tokens without commas; not those right before ``suffix`` nor inside the phrases of ``strip``."""
    t = F.coalesce(text, F.lit(""))
    for phrase in _bounded(strip):
        t = F.replace(t, F.lit(phrase), F.lit(" ")) if phrase else t
    after = "(?!" + "".join(f"\\x{{{ord(c):x}}}" for c in suffix) + ")" if suffix else ""
    found = F.regexp_extract_all(t, F.lit(rf"(?>\p{{Nd}}[\p{{Nd}},]*+(?:\.\p{{Nd}}+)?+){after}"), F.lit(0))
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))


def lost_numbers(pairs: DataFrame, suffix: str = "월", strip: Sequence[str] = ()) -> DataFrame:
    """seg_id, target, number, source, kept: how often each number of a source is there and in its translation, at most as often.

    ``pairs``: seg_id, target, source, translation; without a translation a pair is left out.
    """
    d = pairs.where("translation is not null")
    one = lambda c, s, t: d.select("seg_id", "target", F.explode(numbers_of(F.col(c), suffix, strip)).alias("number"), F.lit(s).alias("s"), F.lit(t).alias("t"))
    n = one("source", 1, 0).union(one("translation", 0, 1)).groupBy("seg_id", "target", "number").agg(F.sum("s").alias("source"), F.sum("t").alias("there"))
    return n.where("source > 0").select("seg_id", "target", "number", "source", F.least("source", "there").alias("kept"))


def tag_items(blocks: DataFrame, keywords: Sequence[tuple[str, str, str]]) -> DataFrame:
    """section_id, item, labels, blocks: the distinct labels of an item that a section's blocks match, and these blocks, in order.

    ``keywords``: (item, label, pattern), patterns over lower-cased text without white space. Null text matches nothing.
    """
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", "")
    b = blocks.select("section_id", "block_id", plain.alias("t"))
    each = [F.when(F.col("t").rlike(p), F.struct(F.lit(i).alias("item"), F.lit(label).alias("label"))) for i, label, p in _bounded(keywords)]
    hits = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<struct<item:string,label:string>>")
    h = b.select("section_id", "block_id", F.explode(hits).alias("h"))
    return h.groupBy("section_id", F.col("h.item").alias("item")).agg(F.array_sort(F.collect_set("h.label")).alias("labels"), F.array_sort(F.collect_set("block_id")).alias("blocks"))


def tag_cooccur(blocks: DataFrame, before: str, after: str) -> DataFrame:
    """section_id, blocks of the sections that have a block of both patterns, and the blocks of either."""
    t = tag_items(blocks, [("c", "before", before), ("c", "after", after)])
    return t.where(F.size("labels") == 2).select("section_id", "blocks")


def snap(changes: DataFrame, blanks: DataFrame, jumps: DataFrame, heights: DataFrame, near: int = 300, window: int = 40, least: float = 25) -> DataFrame:
    """page_id, y, to_y, how: where a change is cut. The middle of the nearest blank run up to ``near`` away (ties: the upper):
    blank; else the row after the greatest jump from ``window`` rows above to below, if it is ``least`` or more (ties: the first):
    edge; else failed, with no place.

    ``changes``: page_id, y; ``blanks``: page_id, y0, y1; ``jumps``: page_id, y, jump; ``heights``: page_id, h. They meet in stretches.
    """
    c = changes.select("page_id", "y").distinct()
    at = lambda y, by: F.floor(y / by)
    around = lambda by, far: F.explode(F.sequence(at(F.col("y") - far, by), at(F.col("y") + far, by))).alias("band")
    mid = F.floor((F.col("y0") + F.col("y1")) / 2)
    b = blanks.select("page_id", mid.alias("m")).withColumn("band", at(F.col("m"), near))
    best = c.select("page_id", "y", around(near, near)).join(b, ["page_id", "band"]).where(F.abs(F.col("m") - F.col("y")) <= near)
    best = best.groupBy("page_id", "y").agg(F.min(F.struct(F.abs(F.col("m") - F.col("y")).alias("far"), "m")).alias("best")).select("page_id", "y", F.col("best.m").alias("blank"))
    j = jumps.select("page_id", F.col("y").alias("row"), "jump").withColumn("band", at(F.col("row"), window))
    e = c.join(heights.select("page_id", "h"), "page_id").select("page_id", "y", "h", around(window, window)).join(j, ["page_id", "band"])
    lo, hi = F.greatest(F.lit(0), F.col("y") - window), F.least(F.col("h") - 1, F.col("y") + window)
    e = e.where((F.col("row") >= lo) & (F.col("row") < hi)).groupBy("page_id", "y").agg(F.max(F.struct("jump", (-F.col("row")).alias("up"))).alias("edge"))
    e = e.where(F.col("edge.jump") >= least).select("page_id", "y", (1 - F.col("edge.up")).alias("edge"))
    d = c.join(best, ["page_id", "y"], "left").join(e, ["page_id", "y"], "left")
    how = F.when(F.col("blank").isNotNull(), "blank").when(F.col("edge").isNotNull(), "edge").otherwise("failed")
    return d.select("page_id", "y", F.coalesce("blank", "edge").alias("to_y"), how.alias("how"))


@view
def term_table(d):
    """Two words that a translation should have: the first words of its source, or another form."""
    return f"select seg_id, concat({d.extract('source', '[A-Za-z]+')}, '|no such form at all') as term from segments where target = 'a' and {d.matches('source', '[A-Za-z]')}"


@view
def length_jumps(d):
    return "select page_id, y, abs(lead(v) over (partition by page_id order by y) - v) as jump from pages_of_lengths"


@view
def long_lines(d):
    return "select page_id, y from pages_of_lengths where v > 200"


@frame("H5_phrase_forms", "segments")
def h5(segments: DataFrame, phrases: Sequence[str] = ("and the", "of the one that", "thing", "er the of on in")) -> DataFrame:
    return phrase_hits(segments.where("target = 'a'"), phrases)


@frame("H13_term_table", "segments", "term_table")
def h13(segments: DataFrame, terms: DataFrame) -> DataFrame:
    return term_accuracy(segments, terms)


@frame("H15_lost_numbers", "segments")
def h15(segments: DataFrame, **rules) -> DataFrame:
    return lost_numbers(segments, **rules)


KEYWORDS = (("origin", "made", "ering|ation"), ("origin", "from", "from|with"), ("contact", "mail", "@[a-z0-9]+[.]"), ("contact", "number", "[0-9]{3}"))


@frame("L2_tag_dictionary", "blocks")
def l2(blocks: DataFrame, keywords: Sequence[tuple[str, str, str]] = KEYWORDS) -> DataFrame:
    t = tag_items(blocks, keywords)
    return t.select("section_id", "item", F.array_join("labels", ",").alias("labels"), F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


@frame("B11_snap_edges", "long_lines", "blank_runs", "length_jumps", "line_heights")
def b11(changes: DataFrame, blanks: DataFrame, jumps: DataFrame, heights: DataFrame, near: int = 3, window: int = 8, least: float = 25) -> DataFrame:
    return snap(changes, blanks, jumps, heights, near, window, least)
