"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words (lower case, punctuation as white space). The CGK random walk
reads a sequence with a pointer: at step j it puts out the word under the pointer and
moves on by a random bit that depends on j and that word. Sequences at a small edit
distance then differ in few steps, so sampled steps of the walk are a locality-sensitive
hash of the edit distance.

Every word of every document begins a window, and so does every word of an item; both are
walked alike, some steps over a window of as many words that slides over the whole item.
Several walks with their own bits and own sampled steps find candidates, and each
candidate's item-sized stretch of the document is compared with the item by its exact word
edit distance. An item of n words that is found with at most ``0.2 n`` edits is a leak.

The fewer words an item has, the shorter are the stretches that ``0.2 n`` edits leave
whole, so ``PLANS`` has shorter windows for shorter items. They are chosen for a recall of
at least 0.99 at that bound for every length; items of fewer than five words may have no
edit and are all found.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import give_back, load, mix, plainly, texts, words

#: For items of at least so many words: words of a window (as many steps), sampled steps, walks.
PLANS = ((30, 12, 8, 4), (15, 8, 5, 4), (10, 6, 4, 4), (5, 3, 3, 4), (1, 4, 4, 1))
EDITS = 0.2
BLOCK = 20_000
QUICK = 22
AT_ONCE = 1 << 18  # bytes of the texts that a task walks at a time
_MUL = np.uint64(0x9E3779B97F4A7C15)


def plan(n: int) -> tuple[int, int, int]:
    """Window, sampled steps and walks for items of ``n`` words (at least one)."""
    width, steps, rounds = next(p[1:] for p in PLANS if n >= p[0])
    return min(width, n), min(steps, n), rounds


@lru_cache
def sampled(width: int, steps: int, rounds: int) -> list[np.ndarray]:
    """The steps that each round looks at: ``steps`` of them, at random, in order."""
    rng = np.random.default_rng(1000 + width)
    return [np.sort(rng.choice(width, steps, replace=False)) for _ in range(rounds)]


def walk_keys(h: np.ndarray, width: int, steps: int, rounds: int, round_: int) -> np.ndarray:
    """LSH key of the walk from each place of ``h`` (word hashes) that has ``width`` words.

    Worked out from the last step to the first for all places at once: the key from step j
    on depends on whether the pointer stays or moves on.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    move = mix(h, 500 + round_)  # bit j: does the pointer move on at step j
    look = set(sampled(width, steps, rounds)[round_].tolist())
    key = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width - 1, -1, -1):
            m = n + j  # the pointer is at most j places on
            bit = (move[:m] >> np.uint64(j % 64)) & np.uint64(1) == 1
            key[:m] = np.where(bit, key[1 : m + 1], key[:m])
            if j in look:
                key[:m] = key[:m] * _MUL + h[:m]
    return mix(key[:n], 600 + round_)


def edit_distance(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any stretch of ``part``; the stretch [from, to)."""
    m = len(part)
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    places = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        up, diag = row + 1, row[:-1] + (part != word)
        new, source = up.copy(), begin.copy()
        better = diag <= new[1:]
        new[1:][better], source[1:][better] = diag[better], begin[:-1][better]
        new[0], source[0] = i, 0
        low = np.minimum.accumulate((new - places) * (m + 2) + (m + 1 - places))  # steps along the row
        at = m + 1 - low % (m + 2)
        row, begin = (low // (m + 2)) + places, source[at]
    to = int(row.argmin())
    return int(row[to]), int(begin[to]), to


def marks(h: np.ndarray) -> np.ndarray:
    """A set of 256 bits with the one bit of each word: (4, words)."""
    bit = np.uint64(1) << (h >> np.uint64(56) & np.uint64(63))
    return np.where(np.arange(4, dtype=np.uint64)[:, None] == h >> np.uint64(62), bit, np.uint64(0))


def quick(key: np.ndarray) -> np.ndarray:
    """A bit for each value of the keys' first ``QUICK`` bits, eight to a byte: a quick no for most places."""
    seen = np.zeros(1 << QUICK - 3, np.uint8)
    place = (key >> np.uint64(64 - QUICK)).astype(np.int64)
    np.bitwise_or.at(seen, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
    return seen


def maybe(seen: np.ndarray, key: np.ndarray) -> np.ndarray:
    """0 for keys that are not there; most others are."""
    place = (key >> np.uint64(64 - QUICK)).astype(np.int64)
    return seen[place >> 3] >> (place & 7).astype(np.uint8) & np.uint8(1)


class Index:
    """LSH keys of a block of items: key -> (item, word of the item at which its window begins)."""

    def __init__(self, items: list[tuple[object, str]]):
        table = pa.array([t for _, t in items], pa.large_string())
        self.ids, self.words = [i for i, _ in items], []
        for t in texts(table):
            w = words(plainly(t))
            self.words += [w.hash[a:b] for a, b in zip(w.first, w.first[1:])]
        self.length = np.array([len(w) for w in self.words])
        self.most = np.array([int(EDITS * len(w)) for w in self.words])
        self.marks = np.stack([np.bitwise_or.reduce(marks(w), 1) for w in self.words]) if self.words else np.zeros((0, 4), np.uint64)
        self.tables: dict[tuple[int, int, int, int], tuple[np.ndarray, ...]] = {}
        for how in sorted({plan(len(w)) for w in self.words if len(w)}):
            own = [k for k, w in enumerate(self.words) if len(w) and plan(len(w)) == how]
            for r in range(how[-1]):
                keys = [walk_keys(self.words[k], *how, r) for k in own]
                key = np.concatenate(keys)
                item = np.repeat(own, [len(x) for x in keys])
                at = np.concatenate([np.arange(len(x)) for x in keys])
                order = np.argsort(key, kind="stable")
                key = key[order]
                self.tables[*how, r] = key, item[order], at[order], quick(key)

    def likely(self, asked: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start, row, from, to) of the candidates whose stretch can have enough of the item's words.

        A bit of the item's words that no word of the stretch has costs an edit, so none
        that is left out is a leak.
        """
        item, start = asked >> 40, (asked & (1 << 40) - 1) - (1 << 39)
        n, most = self.length[item], self.most[item]
        row = (np.searchsorted(first, np.maximum(0, start + n // 2), "right") - 1).clip(0, len(first) - 2)
        lo, hi = np.maximum(first[row], start - most), np.minimum(first[row + 1], start + n + most)
        live = hi - lo >= np.maximum(1, n - most)
        level = np.frexp(np.maximum(1, hi - lo))[1] - 1
        missing = np.zeros(len(item), np.int64)
        cover = marks(h)  # of the 2**j words from each place on
        for j in range(int(level[live].max(initial=-1)) + 1):
            at = np.flatnonzero(live & (level == j))
            there = cover[:, lo[at]] | cover[:, hi[at] - (1 << j)]
            missing[at] = np.bitwise_count(self.marks[item[at]].T & ~there).sum(0)
            cover = cover[:, : -(1 << j)] | cover[:, 1 << j :]
        at = np.flatnonzero(live & (missing <= most))
        return list(zip(*(x[at].tolist() for x in (item, start, row, lo, hi))))

    def leaks(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, from word, to word) of a slice's words; the best find of each row and item."""
        asked = []
        for how, (key, item, at, seen) in self.tables.items():
            got = walk_keys(h, *how)
            place = np.flatnonzero(maybe(seen, got))
            lo = np.searchsorted(key, got[place], "left")
            n = np.searchsorted(key, got[place], "right") - lo
            place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
            each = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            asked.append(np.unique(item[each] << 40 | np.repeat(place, n) - at[each] + (1 << 39)))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, start, row, lo, hi in self.likely(np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.int64), h, first):
            w, most, a, b = self.words[k], int(self.most[k]), int(first[row]), int(first[row + 1])
            if (row, k) in best and best[row, k][0] == 0:
                continue
            if a <= start and start + len(w) <= b and (h[start : start + len(w)] == w).all():
                best[row, k] = 0, start - a, start + len(w) - a
                continue
            if (~np.isin(w, h[lo:hi])).sum() > most:  # a word that is not there costs an edit
                continue
            d, x, y = edit_distance(w, h[lo:hi])
            if d <= most and d < best.get((row, k), (most + 1,))[0]:
                best[row, k] = d, lo + x - a, lo + y - a
        return [(row, k, *found) for (row, k), found in sorted(best.items())]


@lru_cache(4)
def _index(items: tuple) -> Index:
    return Index(list(items))


def _blocks(docs: DataFrame, items: DataFrame, block: int):
    """The items in blocks of about ``block``, each sent to the tasks: its size does not
    follow the benchmark. Items without a text are left out."""
    items = items.where("text is not null").select("item_id", "text")
    n = max(1, -(-items.count() // block))
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield docs.sparkSession.sparkContext.broadcast(tuple(sorted((tuple(r) for r in some), key=str)))


def leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, from_word, to_word: each item found in each row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text. Rows and items without a word
    have no finds; repeated rows are each searched. Each block of items reads the
    documents once.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, from_word long, to_word long"
    out = None
    for sent in _blocks(docs, items, block):

        def run(batches, sent=sent):
            index = _index(sent.value)
            for batch in batches:
                for t in texts(batch.column(1), AT_ONCE):
                    w = words(plainly(t))
                    found = index.leaks(w.hash, w.first)
                    if found:
                        row, item, d, a, b = zip(*found)
                        ids = batch.column(0).slice(t.first, t.rows).take(pa.array(row))
                        cols = [ids, pa.array([index.ids[i] for i in item]), pa.array(d, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "edits", "from_word", "to_word"])
            give_back()

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` (with a text; other columns stay) in which no item is found."""
    k = docs.columns.index("text")
    for sent in _blocks(docs, items, block):

        def run(batches, sent=sent):
            index = _index(sent.value)
            for batch in batches:
                bad: set[int] = set()
                for t in texts(batch.column(k), AT_ONCE):
                    w = words(plainly(t))
                    bad.update(t.first + f[0] for f in index.leaks(w.hash, w.first))
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(load(spark.read.parquet(f"{sf_dir}/documents.parquet")), items)
