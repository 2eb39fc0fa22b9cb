"""Substring dedup: words in runs of 13 that an earlier document has too.

Two forms:

* ``remove_reference``: against a *reference* collection of a bounded size. Its shards
  become suffix automata, sent to all tasks; documents stream through them for their
  matching statistics, and every maximal span of at least 13 words goes.
* ``remove_repeats``: against all documents with a smaller id. Here the reference is the
  corpus itself; automata of all its shards cannot be sent to every task, and every
  document against every shard is quadratic (figures in README.md). A 13-word span is a
  match exactly if its windows are, so windows are compared by 96-bit hashes instead:
  each window names its least 8-word hash (an anchor); windows whose anchor occurs in one
  document only are dropped by a bitmap of a fixed size, the rest meet their equals in a
  shuffle that keeps the least doc_id of each. The bitmap only spares work: what it lets
  through too much is compared exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import load, texts, windows, words
from pagegrain.sources.scratch import Stored

LENGTH = 13
ANCHOR = 8
BITS = 27
SHARD_WORDS = 200_000


class Automaton:
    """Suffix automaton of word sequences; a sequence never matches across its end."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, seq in enumerate(sequences):
            for word in seq:
                last = self._add(last, word)
            last = self._add(last, k)  # a number is no word: nothing matches it

    def _add(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = copy
                    p = link[p]
                link[q] = link[new] = copy
        return new

    def statistics(self, seq: list[bytes]) -> list[int]:
        """For each word, the length of the longest match that ends with it."""
        out, at, n = [], 0, 0
        for word in seq:
            while at and word not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.next[at]:
                at, n = self.next[at][word], n + 1
            out.append(n)
        return out


def _without(words_: list[bytes], gone: np.ndarray) -> list[bytes]:
    return [w for w, g in zip(words_, gone) if not g] if gone.any() else words_


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _digest(doc_id, words_: list[bytes], gone: np.ndarray) -> tuple:
    kept = _without(words_, gone)
    return doc_id, len(words_), len(words_) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, most_words: int = 5_000_000) -> DataFrame:
    """Digest rows of ``docs`` without the spans of ``length`` or more words that ``reference`` has.

    ``reference`` has a text column and at most ``most_words`` words (checked). Null text
    has no words.
    """
    text = F.coalesce("text", F.lit(""))
    sized = reference.select(text.alias("text"), F.size(F.split(text, r"[\x20\x09-\x0D]+")).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > most_words:
        raise ValueError(f"the reference has {total} words; its automata are sent to every task, {most_words} are allowed")
    shards, size = [[]], 0
    for row in sized.toLocalIterator():
        if size > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(row.text.encode().split())
        size += row.n
    sent = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches):
        automata = [Automaton(s) for s in sent.value]
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = (t or "").encode().split()
                edge = np.zeros(len(seq) + 1, np.int64)
                for a in automata:
                    stat = np.array(a.statistics(seq), np.int64)
                    end = np.flatnonzero(stat >= length)
                    np.add.at(edge, end + 1 - stat[end], 1)
                    np.add.at(edge, end + 1, -1)
                rows.append(_digest(doc_id, seq, np.cumsum(edge[:-1]) > 0))
            if rows:
                yield _batch(rows)

    return docs.select(docs.doc_id.cast("long"), "text").mapInArrow(run, _OUT)


def _anchors(w, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and which windows lie in one row."""
    h, _ = windows(w, ANCHOR)
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least = h[:n].copy()
    for j in range(1, length - ANCHOR + 1):
        np.minimum(least, h[j : j + n], out=least)
    return least, w.row[:n] == w.row[length - 1 :]


def shared_anchors(docs: DataFrame, length: int = LENGTH, bits: int = BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` places: the anchors that more than one row has (and maybe others)."""

    def run(batches):
        for batch in batches:
            for t in texts(batch.column(0)):
                w = words(t)
                a, same = _anchors(w, length)
                a, row = a[same], w.row[: len(same)][same]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                a, row = a[new], row[new]
                order = np.lexsort((a, row))
                a, row = a[order], row[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64))], ["h"])

    rows = docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bitmap_of(rows, "h", bits)


def bitmap_of(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """``2 ** bits`` places, those of ``key`` set; rows meet in at most 2 ** bits / 32768 pieces of 4 KB."""
    place = F.pmod(key, F.lit(1 << bits)) + 1  # these functions number bits and buckets from 1
    maps = rows.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, m in maps.toLocalIterator():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)[: len(out)]
    return out


def _set(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    p = (key.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, bits: int = BITS) -> DataFrame:
    """Digest rows of ``docs`` (doc_id, text) without words covered by windows of smaller ids.

    Windows are judged on the input. Null text has no words; a row without an id is
    neither a reference nor cut; rows of one id are no repeats of each other.
    """
    docs = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text", F.hash("text").alias("t"))
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(shared_anchors(docs, length, bits))

    def candidates(batches):
        bitmap = sent.value
        for batch in batches:
            for t in texts(batch.column(2)):
                w = words(t)
                a, same = _anchors(w, length)
                at = np.flatnonzero(same & _set(bitmap, a))
                if not len(at):
                    continue
                k1 = windows(w, length, 21)[0][at].view(np.int64)
                k2 = (windows(w, length, 22)[0][at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                row = w.row[at]
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
                lists = pa.array(cut, pa.int32())
                ids = pa.array(row[cut[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(t.first, t.rows).take(ids) for i in (0, 1)),
                        *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (k1, k2, (at - w.first[row]).astype(np.int32))),
                    ],
                    ["doc_id", "t", "k1", "k2", "pos"],
                )

    kept = docs.where("doc_id is not null").select("doc_id", "t", "text")
    made = kept.mapInArrow(candidates, "doc_id long, t int, k1 array<long>, k2 array<int>, pos array<int>")
    # 32 bits tell the texts of one id apart
    found = made.select("doc_id", "t", F.inline(F.arrays_zip("k1", "k2", "pos")))
    # the first of equal windows is the one with the least id; a running value, so no group is held in memory
    least = F.first("doc_id").over(W.partitionBy("k1", "k2").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    gone = found.withColumn("least", least).where("doc_id > least").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("pos"))
    gone = Stored(gone, "repeat-positions").df
    cut_rows = context.broadcast(bitmap_of(gone.select(F.xxhash64("doc_id", "t").alias("h")), "h", bits))
    docs = docs.select("doc_id", "text", "t").withColumn("h", F.xxhash64("doc_id", "t"))

    def rows_to_cut(batches):
        for batch in batches:
            yield batch.filter(pa.array(_set(cut_rows.value, batch.column(3).to_numpy().view(np.uint64))))

    def whole(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~_set(cut_rows.value, batch.column(3).to_numpy().view(np.uint64))))
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = (t or "").encode().split()
                rows.append(_digest(doc_id, seq, np.zeros(len(seq), bool)))
            if rows:
                yield _batch(rows)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, t, pos in zip(*(c.to_pylist() for c in batch.columns)):
                seq = (t or "").encode().split()
                edge = np.zeros(len(seq) + length + 1, np.int64)
                if pos:
                    pos = np.array(pos)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + length, -1)
                rows.append(_digest(doc_id, seq, np.cumsum(edge)[: len(seq)] > 0))
            if rows:
                yield _batch(rows)

    some = docs.mapInArrow(rows_to_cut, docs.schema).join(gone.hint("merge"), ["doc_id", "t"], "left")
    return docs.mapInArrow(whole, _OUT).union(some.select("doc_id", "text", "pos").mapInArrow(cut, _OUT))


def op6(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark.read.parquet(f"{sf_dir}/documents.parquet")))
