"""Quality rules: base counts, and a log-likelihood ratio of hashed word n-grams.

Words and word pairs are hashed into ``BUCKETS``. Two multinomials with add-one smoothing
are counted over whole tables: one over documents labelled good and not toxic (the
trusted target), one over all documents (the raw corpus). A document's score is the mean
over its n-grams of ln(p_target / p_raw); it is kept from ``CUT`` up. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import load

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 10_000
CUT = -0.1
SYMBOLS = "#*$%&|<>"


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more; windows compared as text."""
    last = F.size(words) - 5
    sorted_ = F.array_sort(
        F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 5), " ").alias("k"), i.alias("p")))
    )

    def repeated(s: Column) -> Column:
        same = lambda a, b: _at(s, a)["k"] == _at(s, b)["k"]
        here = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(((i > 0) & same(i - 1, i)) | same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(here, lambda i: _at(s, i)["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
            lambda a, x: F.struct((a["n"] + x + 5 - F.greatest(a["to"], x)).alias("n"), (x + 5).alias("to")),
            lambda a: a["n"],
        )

    # one-element arrays bind a value that is used more than once
    found = F.transform(F.array(sorted_), repeated)
    return F.get(F.transform(found, covered), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with the base columns and ``grams``, the buckets of words and word pairs."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    d = docs.select("doc_id", text.alias("text"), words.alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("*", F.size("w").alias("n"), lines.alias("lines"), _five(F.col("w")).alias("five"), _grams(F.col("w")).alias("grams"))
    some = F.size(F.array_distinct("five")) < F.size("five")  # equal windows have equal hashes
    repeat = F.when(some, _repeat_words(F.col("w"))).otherwise(0).cast("long")
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        "grams",
    )


def _grams(words: Column) -> Column:
    """Buckets of the words and of the word pairs.

    The hashes are bound as a lambda's argument: a plain reference may be replaced by the
    expression it names, and then be computed anew for each element.
    """

    def buckets(h: Column) -> Column:
        n = F.size(h)
        pair = lambda i: F.pmod(F.xxhash64(_at(h, i - 1), _at(h, i)), F.lit(BUCKETS)).cast("int")
        pairs = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), pair))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), pairs)

    return F.get(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), buckets), F.lit(0))


def _five(words: Column) -> Column:
    """Hashes of the 5-word windows."""

    def windows(h: Column) -> Column:
        n = F.size(h)
        return F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(_at(h, i + j) for j in range(5))))
        )

    return F.get(F.transform(F.array(F.transform(words, lambda x: F.xxhash64(x))), windows), F.lit(0))


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, one array: ln(p_target / p_raw) of each bucket. Its size is fixed."""
    ids = trusted.where("doc_id is not null").select("doc_id", F.lit(1).alias("t")).distinct()
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    # labels grow with the documents: never a broadcast, at any size
    marked = docs.join(ids.hint("merge"), "doc_id", "left").select("t", _grams(words).alias("grams"))
    # the outer form spares a filter on the array's size, which would compute it twice
    rows = marked.select("t", F.explode_outer("grams").alias("b")).where("b is not null")
    counts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("t").alias("target"))
    every = docs.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("b"))
    both = every.join(counts, "b", "left").select(F.struct("b", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("target", "raw"))).alias("x"))
    one = both.agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum("x.target").alias("nt"), F.sum("x.raw").alias("nr"))
    p = lambda c, n: F.log((c + 1) / (F.col(n) + BUCKETS))
    return one.select(F.transform("x", lambda x: p(x["target"], "nt") - p(x["raw"], "nr")).alias("llr"))


def judge(docs: DataFrame, trusted: DataFrame, cut: float = CUT) -> DataFrame:
    """Base columns, base_failed, kept and llr of every row of ``docs`` (doc_id, text).

    ``trusted`` has the doc_id of the target documents. Null text has no words and fails
    the base; with no trusted document every ratio is that of the smoothing alone.
    Repeated rows are judged each.
    """
    d = measured(docs).withColumn("ratio", ratios(docs, trusted).scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + _at(F.col("ratio"), b))
    d = d.withColumn("llr", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= cut)).alias("kept"), "llr",
    )


def op1(spark, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return judge(load(spark.read.parquet(f"{sf_dir}/documents.parquet")), trusted)
