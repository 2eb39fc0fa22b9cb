"""Source divergence audit: how far the word use of a language's sources lies apart.

The vocabulary of a language has the terms of at least ``LEAST_DOCS`` of its documents. The
counts of a term in all sources stand together in one row, and terms with equal rows
are one pattern with a weight. Patterns are dealt out in blocks; in a block they are
sorted so that equal values of a source follow each other, each source becomes a
run-length column, and for a pair of sources the runs' boundaries are intersected and each
difference is multiplied by the length of its run. Sums over blocks are exact integers, so
the deal does not matter. No task holds the vocabulary of a language or source.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.sources.scratch import materialize

LEAST_DOCS, ADDED, TOP = 30, 5, 50
SCALE_STEPS = 3  # of a thousand each: 10^9
BLOCK_CELLS = 1 << 18
HELD = 300_000  # sums in a task's memory before they are passed on
PIECE = 1 << 20
#: letters of ASCII in lower case and bytes of other characters; the rest is a gap
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> Counter:
    """How often each term of a text occurs; a long text is read piece by piece."""
    plain = text.translate(_TABLE)
    if len(plain) <= PIECE:
        return Counter(plain.split(b" "))
    found: Counter = Counter()
    at = 0
    while at < len(plain):
        to = len(plain) if at + PIECE >= len(plain) else plain.find(b" ", at + PIECE)
        to = len(plain) if to < 0 else to
        found.update(plain[at:to].split(b" "))
        at = to
    return found


def counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, occ, df: sums of parts of the rows of ``docs`` (text, lang, source)."""
    names = ["lang", "term", "source", "occ", "df"]

    def rows(held: dict):
        langs, sources, terms, occ, df = [], [], [], [], []
        for (lang, source), sums in held.items():
            langs += [lang] * len(sums)
            sources += [source] * len(sums)
            terms += sums.keys()
            occ += [x[0] for x in sums.values()]
            df += [x[1] for x in sums.values()]
        for a in range(0, len(langs), 50_000):
            cut = slice(a, a + 50_000)
            text = pa.array(terms[cut], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs[cut], pa.string()), text, pa.array(sources[cut], pa.string()), pa.array(occ[cut], pa.int64()), pa.array(df[cut], pa.int64())], names)

    def run(batches):
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = terms_of(text.as_py())
                found.pop(b"", None)
                sums = held.setdefault((lang, source), {})
                before = len(sums)
                for term, n in found.items():
                    x = sums.get(term)
                    if x is None:
                        sums[term] = [n, 1]
                    else:
                        x[0] += n
                        x[1] += 1
                size += len(sums) - before
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, term string, source string, occ bigint, df bigint")


def portion(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)) by long division, exact up to a total of 9 * 10^15."""
    by = total + ADDED * size
    rest, out = count + ADDED, F.lit(0).cast("bigint")
    for _ in range(SCALE_STEPS):
        digit = F.call_function("div", rest * 1000, by)
        out, rest = out * 1000 + digit, F.pmod(rest * 1000, by)
    return F.when(by > 0, out + 1)


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, vec: kept terms and their counts by source, source by source in order."""
    c = counts(docs)
    # by language and term, so that all three aggregates follow one shuffle; rows are sums already
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("occ").alias("occ"), F.sum("df").alias("df"))
    vec = F.array_sort(F.collect_list(F.struct("source", "occ"))).alias("vec")
    return c.groupBy("lang", "term").agg(F.sum("occ").alias("total"), F.sum("df").alias("df"), vec).where(F.col("df") >= least).drop("df")


def described(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """A row for each group that occurs: lang, source, n (kept occurrences), v (kept terms), n_lang and none, the portion of an absent term."""
    # a source's name is in the documents, whether it has terms or not
    groups = docs.select("lang", "source").distinct()
    own = vocab.select("lang", F.explode("vec").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.occ").alias("n"))
    whole = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    d = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("n_lang"))
    return d.withColumn("none", portion(F.lit(0).cast("bigint"), F.col("n"), F.col("v")))


def runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def compared(cells: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each two columns, the sum over rows of weight * |a - b|: pairs of column numbers (a < b) and sums.

    Rows are sorted by the columns with few values first, columns become runs, and the runs of
    two columns meet at the boundaries of both.
    """
    few = np.argsort([len(np.unique(c)) for c in cells.T], kind="stable")
    order = np.lexsort(cells.T[few[::-1]])
    cells, far = cells[order], np.concatenate([[0], np.cumsum(weight[order])])
    begin = [runs(c) for c in cells.T]
    value = [c[b] for c, b in zip(cells.T, begin)]
    a, b = np.triu_indices(cells.shape[1], 1)
    out = np.zeros(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        cut = np.union1d(begin[i], begin[j])
        length = far[np.append(cut[1:], len(cells))] - far[cut]
        x = value[i][np.searchsorted(begin[i], cut, "right") - 1]
        y = value[j][np.searchsorted(begin[j], cut, "right") - 1]
        out[k] = (np.abs(x - y) * length).sum()
    return a, b, out


def distances(portions: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language with kept terms.

    ``portions``: lang, term, source, p of the terms that a source has.
    """
    vec = F.array_sort(F.collect_list(F.struct("source", "p"))).alias("vec")
    patterns = portions.groupBy("lang", "term").agg(vec).groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m"))
    blocks = groups.where("v > 0").groupBy("lang").agg((F.floor(F.max("v") * F.count(F.lit(1)) / BLOCK_CELLS) + 1).alias("blocks"))
    left = patterns.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("vec"), F.col("blocks")).alias("block"), "vec", "m")
    right = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "source", "none")

    def block(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        sources = right["source"].combine_chunks()
        cells = np.tile(right["none"].to_numpy(), (len(left), 1))
        if not len(left) or len(right) < 2:
            a = b = total = np.zeros(0, np.int64)
        else:
            lists = left["vec"].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            flat = lists.flatten()
            at = pa.compute.index_in(flat.field("source"), sources).to_numpy()
            cells[pa.compute.list_parent_indices(lists).to_numpy(), at] = flat.field("p").to_numpy()
            a, b, total = compared(cells, left["m"].to_numpy())
        lang = pa.array([key[0].as_py()] * len(a), pa.string())
        return pa.table([lang, sources.take(pa.array(a)), sources.take(pa.array(b)), pa.array(total)], ["lang", "source", "item", "value"])

    made = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(block, "lang string, source string, item string, value bigint")
    half = made.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return half.union(half.select("lang", F.col("item"), F.col("source"), "value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of the groups of ``docs`` (text, lang, source).

    Part ``pair`` gives each other source of the language and its distance, part ``term`` the
    ``top`` terms that the source has in a larger portion than its language. Null text,
    lang and source are empty strings; repeated rows count each; other columns are not read; a
    group without terms has pairs and no terms; an empty table gives none; ties follow the
    bytes of the item.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("text"), empty("lang"), empty("source"))
    vocab = materialize(vocabulary(docs, least), "vocabulary")
    groups = materialize(described(docs, vocab), "groups")
    has = vocab.select("lang", "term", "total", F.explode("vec").alias("x")).select("lang", "term", "total", "x.source", "x.occ")
    has = has.join(groups, ["lang", "source"])
    has = has.select("lang", "term", "source", portion(F.col("occ"), F.col("n"), F.col("v")).alias("p"), portion(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    term = has.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    far = distances(has.select("lang", "term", "source", "p"), groups)
    both = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pair = both.join(far, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pair).union(ranked(term).where(F.col("rank") <= top))


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
