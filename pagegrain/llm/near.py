"""Near-duplicates by DartMinHash signatures, banded joining and exact checks.

A document is its set of five-word shingles (all its words, if fewer; weight ``tf`` counts
a shingle as often as it occurs). Each unit of weight of a shingle is a cell that throws
darts at hashed times, each at a hashed coordinate; a document keeps the earliest dart of
each coordinate. Two documents agree on a coordinate with the probability of their
(weighted) Jaccard similarity. Only darts thrown before a time that suits the size of the
document are ever made, about ``K ln K`` of them and not ``K`` for each shingle.

Equal sets are one node. Nodes that agree on a whole band meet in its bucket; there each
is compared with the bucket's first node only, and the links give classes. The nodes of
whatever bucket then still holds more than one class meet once more, across classes, on their
rarest cells only (``rare_pairs``, an exact filter), so no class is missed and a large group of
copies costs few pairs.

Joins on ids and pairs, which grow with the documents, are never broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import Texts, give_back, load, mix, packed, texts, unpacked, windows, words
from pagegrain.sources.scratch import Stored

SHINGLE = 5
K, ROWS = 64, 4
LEAST = 0.8
#: rows whose darts are in memory at a time: each throws about K ln K + 3 K of them, however short it is
ROWS_AT_ONCE = 1024


def shingles(t: Texts, weight: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each cell of a slice, by row and hash."""
    w = words(t)
    h, same = windows(w, SHINGLE)
    at = np.flatnonzero(same)
    row, h = w.row[at], h[at]
    n = np.diff(w.first)
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):  # all words as one shingle
        with np.errstate(over="ignore"):
            x = np.uint64(n[r])
            for y in w.hash[w.first[r] : w.first[r + 1]]:
                x = mix(x * np.uint64(31) + y, 9)
        row, h = np.append(row, np.int32(r)), np.append(h, x)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        if weight == "set":
            return row[new], h[new]
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        nth = (np.arange(len(h)) - first).astype(np.uint64)
        h = np.where(nth > 0, mix(h, 5) + nth, h)
    return row, h


def darts(row: np.ndarray, cell: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """Signatures (rows, k): the earliest dart of each coordinate; 0 for a row without cells. ``row`` is sorted."""
    cut = np.searchsorted(row, np.append(np.arange(0, rows, ROWS_AT_ONCE), rows))
    parts = [_darts(row[a:b] - i * ROWS_AT_ONCE, cell[a:b], min(ROWS_AT_ONCE, rows - i * ROWS_AT_ONCE), k) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
    return np.concatenate(parts) if parts else np.zeros((0, k), np.uint64)


def _darts(row: np.ndarray, cell: np.ndarray, rows: int, k: int) -> np.ndarray:
    out = np.zeros((rows, k), np.uint64)
    weight = np.bincount(row, minlength=rows)
    until = (k * np.log(k) + 3 * k) / np.maximum(1, weight)
    todo = weight > 0
    while todo.any():
        sel = np.flatnonzero(todo[row])
        r, c, now = row[sel], cell[sel], np.zeros(len(sel))
        found: list[tuple] = []
        nth = 0
        while len(r):
            u = (mix(c, 100 + 2 * nth) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            now = now - np.log1p(-u)
            live = now <= until[r]
            r, c, now = r[live], c[live], now[live]
            dart = mix(c, 101 + 2 * nth)
            found.append((r * np.int64(k) + (dart % np.uint64(k)).astype(np.int64), now, dart))
            nth += 1
        key, time, dart = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((dart, time, key))
        key, dart = key[order], dart[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        hit = np.zeros(rows * k, bool)
        hit[key[first]] = True
        full = hit.reshape(rows, k).all(1) & todo
        out.reshape(-1)[key[first]] = dart[first]
        todo &= ~full
        until *= 2  # for rows with a coordinate that no dart has hit
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of ``rows`` coordinates, different for each band."""
    n, k = signature.shape
    with np.errstate(over="ignore"):
        x = mix(signature, 3) * np.uint64(0x9E3779B97F4A7C15) ** np.arange(k, dtype=np.uint64)
        return mix(x.reshape(n, k // rows, rows).sum(-1) + np.arange(k // rows, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), 4)


def signed(docs: DataFrame, weight: str = "set") -> DataFrame:
    """doc_id, fingerprint of the cells (two longs; null without words) and band hashes."""

    def run(batches):
        for batch in batches:
            for t in texts(batch.column(1)):
                row, cell = shingles(t, weight)
                n = np.bincount(row, minlength=t.rows)
                prints = []
                for seed in (11, 12):
                    total = np.zeros(t.rows + 1, np.uint64)
                    np.cumsum(np.bincount(row, minlength=t.rows), out=total[1:])
                    with np.errstate(over="ignore"):
                        run_ = np.concatenate([[np.uint64(0)], np.cumsum(mix(cell, seed), dtype=np.uint64)])
                        prints.append((run_[total[1:].astype(int)] - run_[total[:-1].astype(int)]).view(np.int64))
                got = bands(darts(row, cell, t.rows)).view(np.int64)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(t.first, t.rows).cast(pa.int64()),
                        *(pa.array(p, mask=none) for p in prints),
                        pa.FixedSizeListArray.from_arrays(pa.array(got.reshape(-1)), got.shape[1]).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "fp1", "fp2", "bands"],
                )
        give_back()

    return docs.mapInArrow(run, "doc_id long, fp1 long, fp2 long, bands array<long>")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node`` and ``root`` (its component's least node) for the ends of edges (a, b), a <> b;
    roots themselves are not listed.

    Alternating large-star and small-star steps, each written to the shared folder; no
    neighbourhood is ever collected.
    """
    e = Stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    was = None
    while True:
        both = e.df.union(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = Stored(large, name)
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u")
        small = small.select("v", "m").where("v > m").union(least).toDF("u", "v").distinct()
        new = Stored(small, name)
        now = new.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        e.drop(), large.drop()
        e = new
        if now == was:
            return e.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = now


def checked(pairs: DataFrame, cells: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cells are at least so similar, with the similarity.

    Cells are compared by 32 bits of their hashes, with repeats counted.
    """

    def run(batches):
        for batch in batches:
            keep, sims = [], []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint32) for c in (left, right))
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                s = common / max(1, len(both) - common)
                if s >= least:
                    keep.append(i)
                    sims.append(s)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sims)], ["a", "b", "similarity"])
        give_back()

    left, right = cells.select(F.col("doc_id").alias("a"), F.col("cells").alias("ca")), cells.select(F.col("doc_id").alias("b"), F.col("cells").alias("cb"))
    got = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "ca", "cb")
    return got.mapInArrow(run, "a long, b long, similarity double")


def cells_of(docs: DataFrame, weight: str = "set") -> DataFrame:
    """doc_id and its cells as sorted 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for t in texts(batch.column(1)):
                row, cell = shingles(t, weight)
                cut = np.searchsorted(row, np.arange(t.rows + 1))
                short = (cell >> np.uint64(32)).astype(np.uint32)
                out = [np.sort(short[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows).cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "cells"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, cells binary")


def rare_pairs(cells: DataFrame, root: DataFrame, least: float) -> DataFrame:
    """Every pair (a, b) of different classes that can be similar enough, by an exact prefix filter.

    ``cells``: doc_id and cells of the rows to compare; ``root``: node and root. Cells are ordered by
    how many rows have them, the rarest first. Two rows of n and m cells with a similarity of t share at
    least t * max(n, m) cells, so the first n - ceil(t n) + 1 cells of one and the like of the other have a cell in common.
    Cells that a whole group has come last and are keys of none that has enough others; those that only one
    row has are counted and need no key. Where two rows meet, what can still follow behind their places must suffice.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32).astype(np.int64)
                if len(part):
                    new = np.append(True, part[1:] != part[:-1])
                    nth = np.arange(len(part)) - np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
                    same = lambda j: pa.array(np.full(len(part), batch.column(j)[i].as_py()))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(0), same(1), same(3), pa.array((part << 24) + nth)], ["id", "node", "n", "cell"])
        give_back()

    d = cells.select(F.xxhash64("doc_id", "cells").alias("id"), F.col("doc_id").alias("node"), "cells", (F.octet_length("cells") / 4).cast("long").alias("n"))
    rows = Stored(d.mapInArrow(run, "id long, node long, n long, cell long"), "near-cell-rows").df
    common = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = rows.join(common.hint("merge"), "cell")
    alone = shared.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(W.partitionBy("id").orderBy("f", "cell")) + F.col("n") - F.col("shared")
    keys = shared.join(alone.hint("merge"), "id").withColumn("i", place).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    keys = Stored(keys.select("node", "n", "cell", "i").join(root.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-prefix").df
    left, right = (keys.select("cell", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "i", "root"))) for s in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    enough = 1 + F.least(n - F.col("i_a"), m - F.col("i_b")) >= least / (1 + least) * (n + m) - 1e-6
    near = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (F.least(n, m) >= least * F.greatest(n, m) - 1e-6)
    return left.join(right, "cell").where(near & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def classes(docs: DataFrame, least: float = LEAST, weight: str = "set") -> DataFrame:
    """doc_id, class_id and n_same of every row of ``docs`` (doc_id, text).

    ``class_id`` is the least doc_id of the documents joined by links of at least ``least``;
    ``n_same`` counts the rows with the same set of shingles. Rows without a word (null,
    empty) or without an id are classes by themselves. An id on several rows stands for
    one document: its texts share a class.
    """
    sig = Stored(signed(docs, weight), "near-signed")
    full = sig.df.where("fp1 is not null and doc_id is not null")
    node = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_same"))
    node = Stored(node, "near-nodes")
    # a row per node: the row of its least doc_id has the bands of all of them
    first = full.join(node.df.hint("merge"), ["fp1", "fp2"]).where("doc_id = node")
    keys = Stored(first.select("node", F.explode("bands").alias("key")).distinct(), "near-keys")
    hubs = keys.df.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    met = keys.df.join(hubs.hint("merge"), "key").where("node > a")
    pairs = Stored(met.select("a", F.col("node").alias("b")).distinct(), "near-pairs")
    ends = pairs.df.select(F.col("a").alias("doc_id")).union(pairs.df.select("b")).distinct()
    cells = Stored(cells_of(docs.join(ends.hint("merge"), "doc_id", "left_semi"), weight).distinct(), "near-cells")  # an id may have several texts
    links = Stored(checked(pairs.df, cells.df, least), "near-links")
    # texts of one id
    same = full.select("doc_id", "fp1", "fp2").join(node.df, ["fp1", "fp2"]).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    again = same.join(node.df.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    root = components(links.df.select("a", "b").union(again), "near-stars")

    # nodes of buckets that hold several classes: every pair across classes that may be a link and is not yet compared
    of = Stored(keys.df.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-of")
    mixed = of.df.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi and n > 2").select("key")
    inside = of.df.join(mixed, "key").select(F.col("node").alias("doc_id")).distinct()
    rest = rare_pairs(cells.df.join(inside.hint("merge"), "doc_id", "left_semi"), root, least)
    rest = Stored(rest.join(pairs.df.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    more = Stored(checked(rest.df, cells.df, least), "near-more")
    if more.df.limit(1).count():
        root = components(links.df.select("a", "b").union(again).union(more.df.select("a", "b")), "near-stars")

    named = sig.df.join(node.df, ["fp1", "fp2"], "left").join(root, "node", "left")
    return named.select("doc_id", F.coalesce("root", "node", "doc_id").alias("class_id"), F.coalesce("n_same", F.lit(1)).alias("n_same"))


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` (with doc_id and text; other columns stay) with one row of each class.

    The document with the least id stays, of several rows of one id the one with the
    least text. Rows without an id all stay.
    """
    keep = classes(load(docs), least).where("class_id = doc_id").select("doc_id").distinct()
    rows = packed(docs)
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    kept = rows.where("doc_id is not null").join(keep.hint("merge"), "doc_id", "left_semi").withColumn("nth", nth).where("nth = 1")
    return unpacked(kept.select(rows.columns).union(rows.where("doc_id is null")), docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    return classes(load(spark.read.parquet(f"{sf_dir}/documents.parquet")))
