"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are coded byte by byte (A-Z in lower case, then an end mark). Each byte is a path of
binary decisions in a Huffman tree that belongs to the byte before it. Three predictors
give each decision a probability: the tree's own counts (one byte of context), hashed
counts after the last four bytes, and hashed counts after the current word's beginning.
All counts come from every training document and are summed by Spark. The tables of the
hashed counts grow with the text: they have at least ``SPREAD`` places for each distinct
pair of a context and the byte after it. Tasks count pairs; their counts are shuffled many to
a row, by the first bits of the context's hash, which are the first bits of its places too, so
the distinct pairs of a row are turned into decisions where they lie. The tables are written to
the shared folder by range of places; the first Python worker of an executor reads them from there with Arrow's file systems into a file that
all its workers map.

A document mixes the predictors in the logistic domain with a set of weights chosen by a
gate (how often the word predictor has seen the place), and refines the result by an
adaptive map from the mixed
estimate to observed frequencies. Weights and map follow the document: after each block
of it they take a step against the coding error. Every document begins with the weights
that documents of one training fold, kept out of the counts until then, end with on
average; for scoring the counts have this fold too.
"""

from __future__ import annotations

import fcntl
import heapq
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import Texts, fold, give_back, keep_freed, load, mix, small_batches, texts, words
from pagegrain.sources.scratch import Stored

LEAST_BITS = 21  # of the places of a table
SPREAD = 4
SKETCH = 12  # bits of the registers that estimate the distinct pairs
HOT = 1 << 16
HELD_KEYS = 1 << 20  # that a task holds before it passes them on
AT_ONCE = 1 << 18  # bytes of the texts that a task codes at a time
CHUNK = 1 << 13  # bytes whose decisions are worked out at a time, to stay in a core's cache
GATES, MAP = 8, 24
LIMIT = np.float32(7.999)  # of a mixed stretch
UNIT = 1 / 256  # of the stretches in the tables
SCALE = np.array([1, UNIT, UNIT], np.float32)
PART = 12  # first bits that the keys of a row of ``packed`` share
REST = 64 - PART, 12, 49 - PART, 49 - PART  # the other bits, by kind
READER, WIDE = "spark.sql.parquet.columnarReaderBatchSize", 16
LINES, SEEN = 1 << 16, 1 << 17
RATE, MAP_PRIOR = 0.002, 20.0
START = np.array([0.1, 0.65, 0.5], np.float32)
END = 0xFF  # no byte of UTF-8
HELD, WEIGHTS = 2, 3  # folds of 7: held out, and for the first weights
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_END = np.array([END], np.uint8)
_BREAK = (np.arange(256) <= 0x20) | (np.arange(256) == END)
_LETTER = (mix(np.arange(64 << 8, dtype=np.uint64), 31) >> np.uint64(32)).astype(np.uint32)  # by place in the word and byte


def stretch(p):
    return np.log(p / (1 - p))


class Coded:
    """The bytes to code of a slice, with their contexts: each row's bytes, then the end mark."""

    def __init__(self, t: Texts, contexts: bool = True):
        size = np.diff(t.ends) + 1
        self.rows, self.size = t.rows, size
        first = np.cumsum(size) - size
        text = np.ones(len(t.data) + t.rows, bool)
        text[first + size - 1] = False
        now = np.full(len(text), END, np.uint8)
        now[text] = _LOWER[t.data]
        self.now, self.before = now, np.concatenate([_END, now[:-1]])  # each row follows an end mark
        if not contexts:
            return
        at = np.arange(len(now), dtype=np.int32)
        four = self.before.astype(np.uint32)
        for k in (1, 2, 3):
            four[k:] |= self.before[:-k].astype(np.uint32) << np.uint32(8 * k)
        for k in range(4):  # only marks stand before a row
            four[first[size > k] + k] |= np.uint32(0xFFFFFFFF << 8 * k & 0xFFFFFFFF)
        begin = np.concatenate([[0], np.maximum.accumulate(np.where(_BREAK[now[:-1]], at[1:], 0))]).astype(np.int32)
        with np.errstate(over="ignore"):
            self.four = (four * np.uint32(0x9E3779B1)) ^ (four >> np.uint32(15))
            total = np.zeros(len(now) + 1, np.uint32)
            np.cumsum(_LETTER[(at - begin & 63) << 8 | now], dtype=np.uint32, out=total[1:])
            self.word = total[:-1] - total[begin]


class Trees:
    """A Huffman tree for each byte before, from counts (256, 256) of byte pairs."""

    def __init__(self, pairs: np.ndarray):
        self.length = np.zeros((256, 256), np.uint8)
        self.offset = np.zeros((256, 256), np.int32)
        nodes, bits = [], []
        known = np.zeros(1 << 16, np.float32)
        at = 0
        for before in range(256):
            heap = [(float(n) + 0.02, k) for k, n in enumerate(pairs[before])]
            heapq.heapify(heap)
            kids, weight, node = {}, {k: w for w, k in heap}, 256
            while len(heap) > 1:
                (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
                kids[node], weight[node] = (a, b), w0 + w1
                heapq.heappush(heap, (w0 + w1, node))
                node += 1
            stack = [(node - 1, ())]
            while stack:
                k, path = stack.pop()
                if k < 256:
                    self.length[before, k], self.offset[before, k] = len(path), at
                    at += len(path)
                    nodes += [n for n, _ in path]
                    bits += [bit for _, bit in path]
                    continue
                own = before * 256 + k - 256
                a, b = kids[k]
                known[own] = stretch((weight[b] + 0.2) / (weight[a] + weight[b] + 0.4))
                stack += [(a, (*path, (own, 0))), (b, (*path, (own, 1)))]
        nodes = np.array(nodes, np.uint16)
        self.known = known[nodes]
        # of each decision on a path: 254 less the node's number in its tree (0 is the root, the frequent ones follow), and the bit
        self.step = (254 - (nodes & 255)) << 1 | np.array(bits, np.uint16)

    def paths(self, pair):
        """For pairs of bytes (before << 8 | now): the decisions up to each, which pair each belongs to, and its place in the path arrays."""
        n = self.length.reshape(-1)[pair]
        ends = np.cumsum(n, dtype=np.int64)
        begin = ends - n
        of = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        of[begin[1:]] = 1
        np.cumsum(of, out=of)
        at = (self.offset.reshape(-1)[pair] - begin)[of]
        at += np.arange(len(of))
        return ends, of, at


def hashes(context: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """32 bits for each context of table ``k``; no two contexts after the same byte share them.

    The decisions of the byte after a context begin at the place that the first bits say. Their places differ from
    it in the last eight bits (by ``Trees.step``), those of frequent decisions in fewer: they lie together.
    """
    with np.errstate(over="ignore"):
        x = (context + before.astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35 + 2 * k)
        return x ^ (x >> np.uint32(13))


def pieces(rows: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows' stretches in groups of about ``most`` bytes."""
    at, ends = 0, np.cumsum(size)
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + most, "right")))
        yield rows[at:to], begin[at:to], size[at:to]
        at = to


def enter(seen: np.ndarray, keys: np.ndarray) -> None:
    """Enter distinct keys into registers: each has the greatest rank (leading zeros and one) of its hashes (HyperLogLog)."""
    h = mix(keys, 41)
    rank = 65 - SKETCH - np.frexp((h & np.uint64((1 << 64 - SKETCH) - 1)).astype(np.float64))[1]
    np.maximum.at(seen, (h >> np.uint64(64 - SKETCH)).astype(np.int64), rank)


def coded_pairs(c: Coded, apart: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table, the distinct keys of a slice in order, and how often each occurs.

    A key has the context's hash (32 bits), the byte before, the byte and whether its row is of the fold for the first weights.
    """
    low = c.before.astype(np.uint64) << np.uint64(9) | c.now.astype(np.uint64) << np.uint64(1)
    if apart is not None:
        low |= np.repeat(apart, c.size)
    return [np.unique(hashes(x, c.before, k).astype(np.uint64) << np.uint64(17) | low, return_counts=True) for k, x in enumerate((c.four, c.word))]


def sketch(seen: np.ndarray, c: Coded) -> None:
    """Enter a slice's distinct pairs of a context and the byte after it into ``seen`` (2, 2**SKETCH)."""
    for k, (keys, _) in enumerate(coded_pairs(c)):
        enter(seen[k], keys >> np.uint64(1))


def distinct_of(seen: np.ndarray) -> float:
    """The number of distinct pairs by one row of registers."""
    m = len(seen)
    found = 0.7213 / (1 + 1.079 / m) * m * m / (2.0**-seen).sum()
    none = int((seen == 0).sum())
    return m * np.log(m / none) if none and found <= 2.5 * m else found


def bits_for(seen: np.ndarray) -> list[int]:
    """Bits of the places of each table, by the registers of all training rows."""
    return [max(LEAST_BITS, int(np.ceil(np.log2(SPREAD * max(1, distinct_of(x)))))) for x in seen]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    key = np.concatenate([k for k, _ in parts])
    order = np.argsort(key)
    key, n = key[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


NAMES = ["kind", "part", "n", "total", "low", "high", "times"]
ROWS = "kind long, part long, n long, total long, low binary, high binary, times binary"


def packed(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Distinct keys in order, a row for those that share their first bits (``part``), with how often each occurs.

    ``low`` and ``high`` have 32 of the other bits of each key, ``n`` is the number of keys and ``total`` of what they count.
    """
    rest = REST[kind]
    part = (key >> np.uint64(rest)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[begin, len(key)]

    def binary(x):
        return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    n = n.astype(np.int64)
    high = (key & np.uint64((1 << rest) - 1)) >> np.uint64(32)
    numbers = [np.full(len(begin), kind), part[begin], np.diff(ends), np.add.reduceat(n, begin)]
    return pa.RecordBatch.from_arrays([*map(pa.array, numbers), binary(key.astype(np.uint32)), binary(high.astype(np.uint32)), binary(n)], NAMES)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Kind, part, keys and counts of each row of ``packed``."""
    for kind, part, low, high, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "low", "high", "times"))):
        key = np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)
        yield kind, part, key | np.uint64(part << REST[kind]), np.frombuffer(n, np.int64)


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read ``WIDE`` rows of ``counted`` at a time: each has the keys of a part, a 4,096th of all."""
    was = spark.conf.get(READER)
    spark.conf.set(READER, WIDE)
    try:
        with small_batches(spark, WIDE):
            yield
    finally:
        spark.conf.set(READER, was)


def counted(docs: DataFrame) -> DataFrame:
    """Rows of ``packed`` for the training rows, one for each kind and part: words by hash (0), pairs of bytes (1), keys of ``coded_pairs`` (2 and 3).

    Tasks count what they read; what they have found meets by kind and part and is summed. Among the pairs of bytes,
    ``LINES`` counts the rows, and ``SEEN + 64 * register + rank`` says that the sketch of a task that sums has this rank.
    """

    def run(batches):
        pairs, parts = np.zeros(1 << 16, np.int64), {0: [], 2: [], 3: []}
        rows = 0
        keep_freed()
        for batch in batches:
            apart = batch.column(1).to_numpy(zero_copy_only=False) == WEIGHTS
            for t in texts(batch.column(0), AT_ONCE):
                rows += t.rows
                c = Coded(t)
                pairs += np.bincount(c.before.astype(np.int64) << 8 | c.now, minlength=1 << 16)
                parts[0].append(np.unique(words(t._replace(data=_LOWER[t.data])).hash, return_counts=True))
                for k, (keys, n) in enumerate(coded_pairs(c, apart[t.first : t.first + t.rows])):
                    parts[2 + k].append((keys, n))
                for kind, have in parts.items():
                    if sum(len(k) for k, _ in have) > HELD_KEYS:
                        have[:] = [merged(have)]
                        if len(have[0][0]) > HELD_KEYS // 2:
                            yield packed(kind, *have.pop())
        for kind, have in parts.items():
            if sum(len(k) for k, _ in have):
                yield packed(kind, *merged(have))
        parts.clear()
        give_back()
        if not rows:
            return
        got = np.flatnonzero(pairs)
        yield packed(1, np.append(got, LINES).astype(np.uint64), np.append(pairs[got], rows))

    def meet(batches):
        at, have, seen = None, [], np.zeros((2, 1 << SKETCH), np.int64)

        def found():
            key, n = merged(have)
            if at[0] > 1:
                enter(seen[at[0] - 2], key >> np.uint64(1))
            return packed(at[0], key, n)

        keep_freed()
        for batch in batches:
            for kind, part, key, n in unpacked(batch):
                if at != (kind, part):
                    if have:
                        yield found()
                    at, have = (kind, part), []
                have.append((key, n))
                if len(have) > 1 and sum(len(k) for k, _ in have[1:]) > max(HELD_KEYS, len(have[0][0])):
                    have = [merged(have)]
        if have:
            yield found()
        ranks = seen.reshape(-1)
        some = np.flatnonzero(ranks)
        if len(some):
            yield packed(1, (SEEN + 64 * some + ranks[some]).astype(np.uint64), np.ones(len(some), np.int64))
        give_back()

    rows = docs.select("text", F.col("fold").cast("long")).mapInArrow(run, ROWS)
    rows = rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "kind", "part").sortWithinPartitions("kind", "part")
    return rows.mapInArrow(meet, ROWS)


def vocabulary(counts: DataFrame) -> DataFrame:
    """``key``, ``n`` of the distinct words of ``counted``."""

    def run(batches):
        for batch in batches:
            for _, _, key, n in unpacked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return counts.where("kind = 0").mapInArrow(run, "key long, n long")


def tables(counts: DataFrame, trees: Trees, bits: list[int]) -> Stored:
    """Both hashed predictors' tables, a written row for each part of ``counted``: its keys have places of their own.

    Each key becomes the decisions on the path to its byte. A place is a stretch in ``UNIT``, and its age in the last bits.
    Column known0 leaves out the fold for the first weights, known1 has it.
    """
    sent = counts.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        tree = sent.value
        keep_freed()
        for batch in batches:
            for kind, part, key, n in unpacked(batch):
                size = bits[kind - 2] - PART
                _, of, at = tree.paths((key >> np.uint64(1) & np.uint64(0xFFFF)).astype(np.int64))
                step = tree.step[at].astype(np.int64)
                code = (key >> np.uint64(49 - bits[kind - 2])).astype(np.int64)[of] ^ step >> 1
                code = (code & (1 << size) - 1) << 2 | (key & np.uint64(1)).astype(np.int64)[of] << 1 | step & 1
                found = np.bincount(code, n[of], 4 << size).reshape(-1, 2, 2)
                made = [pa.array([kind - 2 << 32 | part])]
                for c in (found[:, 0], found.sum(1)):
                    total = c.sum(-1)
                    value = np.round(stretch((c[:, 1] + 0.3) / (total + 0.6)) / UNIT).clip(-4096, 4095).astype("<i2")
                    age = np.log2(total + 1).astype("<i2").clip(0, GATES - 1)
                    made.append(pa.array([(value << 3 | age).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, ["part", "known0", "known1"])
        give_back()

    with wide_rows(counts.sparkSession):
        return Stored(counts.where("kind > 1").mapInArrow(run, "part long, known0 binary, known1 binary"), "lm-tables")


@contextmanager
def mapped(name: str, size: int, fill: Callable[[np.ndarray], None]) -> Iterator[np.ndarray]:
    """``size`` bytes that the workers of an executor share, by memory map from a file in their temp folder.

    The first of them lets ``fill`` write the bytes; the last that uses them deletes the file. A byte behind them
    says that they are whole.
    """
    path = os.path.join(tempfile.gettempdir(), name)

    def still(file) -> bool:
        return os.path.exists(path) and os.path.samestat(os.fstat(file.fileno()), os.stat(path))

    def whole(file) -> bool:
        return os.fstat(file.fileno()).st_size == size + 1 and os.pread(file.fileno(), 1, size) == b"\1"

    while True:
        with open(path, "a+b") as file:
            fcntl.flock(file, fcntl.LOCK_SH)
            if still(file) and whole(file):
                try:
                    yield np.memmap(path, np.uint8, "r")[:size]
                finally:
                    with suppress(BlockingIOError):  # others use the file
                        fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        if still(file):
                            os.unlink(path)
                return
            fcntl.flock(file, fcntl.LOCK_EX)
            if still(file) and not whole(file):
                try:
                    os.truncate(path, 0)
                    os.truncate(path, size + 1)
                    data = np.memmap(path, np.uint8, "r+")
                    fill(data[:size])
                    data[size] = 1
                except BaseException:
                    os.unlink(path)
                    raise


class Model:
    """Trees, where the tables of the hashed predictors are, and first weights.

    Tasks read the tables themselves from the shared folder, once for all workers of an executor that use them at the
    time: neither the driver nor a broadcast has them.
    ``whole``: with the fold for the first weights.
    """

    def __init__(self, trees: Trees, size: list[int], path: str, whole: bool):
        self.trees, self.size, self.path, self.whole = trees, size, path, int(whole)
        self.first = np.broadcast_to(START, (GATES, 3)).copy()

    def _copy(self, data: np.ndarray) -> None:
        """Write the tables of ``opened``; places that nobody has seen are 0."""
        files, path = pa_fs.FileSystem.from_uri(self.path)
        known = self._parts(data)
        columns = ["part", f"known{self.whole}"]
        for batch in dataset(path, filesystem=files, format="parquet").to_batches(columns=columns, batch_size=16, batch_readahead=1, fragment_readahead=1):
            for part, value in zip(batch.column(0).to_pylist(), (x.as_buffer() for x in batch.column(1))):
                k = part >> 32
                at = (part & 0xFFFFFFFF) << self.size[k] - PART
                known[k][at : at + (1 << self.size[k] - PART)] = np.frombuffer(value, "<i2")
        give_back()

    def _parts(self, data: np.ndarray) -> list[np.ndarray]:
        a = 2 << self.size[0]
        return [data[:a].view("<i2"), data[a:].view("<i2")]

    @contextmanager
    def opened(self) -> Iterator[Model]:
        """Itself, with the tables ``known`` while the context lasts."""
        name = f"lm-{zlib.crc32(self.path.encode()):08x}-{self.path.rsplit('/', 1)[-1]}-{self.whole}"
        with mapped(name, sum(2 << b for b in self.size), self._copy) as data:
            self.known = self._parts(data)
            try:
                yield self
            finally:
                del self.known, data

    def bits(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each row of a slice, and the last weights (rows, GATES, 3)."""
        c, tree = Coded(t), self.trees
        pair = c.before.astype(np.int64) << 8 | c.now
        place = [(hashes(x, c.before, k) >> np.uint32(32 - self.size[k])).astype(np.int64) for k, x in enumerate((c.four, c.word))]
        cost = np.zeros(t.rows)
        # stored by predictor; those of the hashed ones take the tables' units
        weight = np.ascontiguousarray(np.broadcast_to(self.first * SCALE, (t.rows, GATES, 3)).reshape(-1, 3).T)
        centre = (np.arange(MAP) - (MAP - 1) / 2) / 1.5
        level = np.broadcast_to((1 / (1 + np.exp(-centre))).astype(np.float32), (t.rows, MAP)).reshape(-1).copy()
        first = np.cumsum(c.size) - c.size
        lo, longest = 0, int(c.size.max(initial=0))
        while lo < longest:
            hi = lo + min(1024, max(64, lo))
            rows = np.flatnonzero(c.size > lo)
            slope = np.zeros((3, t.rows * GATES))
            met = np.zeros(2 * t.rows * MAP, np.int64)
            for row, begin, size in pieces(rows, first[rows] + lo, np.minimum(c.size[rows], hi) - lo, CHUNK):
                upto = np.cumsum(size)
                sel = np.repeat(begin - upto + size, size)
                sel += np.arange(len(sel))
                ends, of, at = tree.paths(pair[sel])
                ends = ends[upto - 1]  # of each row's decisions
                begin = np.concatenate([[0], ends[:-1]])
                step = tree.step[at]
                node = (step >> 1).astype(np.int64)
                step &= 1
                bit = step.astype(np.float32)
                four, word = (p[sel][of] for p in place)
                four ^= node
                word ^= node
                four, word = self.known[0][four], self.known[1][word]
                gate = np.repeat(row * GATES, ends - begin)
                spot = gate * (MAP // GATES)
                gate += word & (GATES - 1)
                x = (tree.known[at], (four >> 3).astype(np.float32), (word >> 3).astype(np.float32))
                dot = weight[0][gate] * x[0]
                for k in (1, 2):
                    part = weight[k][gate]
                    part *= x[k]
                    dot += part
                np.maximum(dot, -LIMIT, out=dot)
                np.minimum(dot, LIMIT, out=dot)
                p = np.exp(-dot)
                p += 1
                np.reciprocal(p, out=p)
                dot *= np.float32(1.5)
                dot += np.float32(MAP / 2)
                spot += dot.astype(np.int64)
                fine = level[spot]
                fine += p
                fine *= np.float32(0.5)
                fine += bit
                fine -= 1
                np.abs(fine, out=fine)
                cost[row] -= np.add.reduceat(np.log(fine, out=fine), begin, dtype=np.float64)
                bit -= p
                for k in range(3):
                    slope[k] += np.bincount(gate, bit * x[k], t.rows * GATES)
                spot *= 2
                spot += step
                met += np.bincount(spot, minlength=len(met))
            lo = hi
            weight += ((RATE * SCALE * slope.T).clip(-0.25, 0.25) * SCALE).T.astype(np.float32)
            ones, seen = met[1::2], met[::2] + met[1::2]
            level += ((ones - seen * level) / (seen + MAP_PRIOR)).astype(np.float32)
            np.clip(level, 1e-4, 1 - 1e-4, out=level)
        return cost / np.log(2), (weight.T / SCALE).reshape(t.rows, GATES, 3)


def first_weights(docs: DataFrame, model: Model) -> np.ndarray:
    """The mean of the weights that ``docs`` end with, each weighted by its bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total, size = np.zeros(GATES * 3), 0
        keep_freed()
        with sent.value.opened() as lm:
            for batch in batches:
                for t in texts(batch.column(0), AT_ONCE):
                    n = np.diff(t.ends) + 1
                    total += (lm.bits(t)[1].reshape(t.rows, -1) * n[:, None]).sum(0)
                    size += int(n.sum())
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES * 3)), pa.array(total), pa.array(np.full(GATES * 3, size))], ["k", "w", "n"])

    rows = docs.select("text").mapInArrow(run, "k long, w double, n long").groupBy("k").agg(F.sum("w"), F.sum("n")).collect()
    out = model.first.reshape(-1).copy()
    for k, w, n in rows:
        out[k] = w / n if n else out[k]
    return out.reshape(GATES, 3)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    ``docs`` has doc_id and text (null: empty, one end token). Words are counted by 64-bit
    hashes. The most frequent words, a fixed number, are looked up in the tasks; the others
    meet their counts in a join. Repeated rows are scored each.
    """
    docs = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text", fold("doc_id", 7).alias("fold"))
    train = docs.where(F.col("fold") != HELD)
    with small_batches(docs.sparkSession):
        counts = Stored(counted(train), "lm-counts").df
    pairs, ends, seen = np.zeros(1 << 16), 0, np.zeros(2 << SKETCH)
    with wide_rows(docs.sparkSession):
        some = counts.where("kind = 1").toArrow().to_batches()  # pairs of bytes, and some ranks a register
        vocab = Stored(vocabulary(counts), "lm-words").df
    for batch in some:
        for _, _, key, n in unpacked(batch):
            rank = key[key >= SEEN].astype(np.int64) - SEEN
            np.maximum.at(seen, rank >> 6, rank & 63)
            ends += int(n[key == LINES].sum())
            pairs[key[key < LINES]] = n[key < LINES]
    total, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all, v_all = total + ends, distinct + (ends > 0)
    common = vocab.orderBy(F.desc("n"), "key").limit(HOT).collect()
    hot_key, hot_n = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20)
    for key, n in reversed(common):  # where two want a place, the more frequent has it
        hot_key[(key % 2**64) >> 44], hot_n[(key % 2**64) >> 44] = key % 2**64, n

    trees, bits = Trees(pairs.reshape(256, 256)), bits_for(seen.reshape(2, -1))
    places = tables(counts, trees, bits)
    first = first_weights(train.where(F.col("fold") == WEIGHTS), Model(trees, bits, places.path, whole=False)).astype(np.float32)
    model = Model(trees, bits, places.path, whole=True)
    model.first = first
    sent = docs.sparkSession.sparkContext.broadcast((model, hot_key, np.log10(hot_n + 1)))

    def run(batches):
        keep_freed()
        with sent.value[0].opened() as lm:
            yield from scored(batches, lm, *sent.value[1:])
        give_back()

    def scored(batches, lm, keys, logs):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for t in texts(batch.column(1), AT_ONCE):
                bits, _ = lm.bits(t)
                w = words(t._replace(data=_LOWER[t.data]))
                at = (w.hash >> np.uint64(44)).astype(np.int64)
                hit = keys[at] == w.hash
                row, h = w.row[~hit], w.hash[~hit]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)])
                times = np.diff(np.r_[new, len(h)])
                cut = pa.array(np.searchsorted(row[new], np.arange(t.rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uid + np.arange(t.rows)),
                        batch.column(0).slice(t.first, t.rows),
                        batch.column(2).slice(t.first, t.rows),
                        pa.array(np.diff(w.first) + 1),
                        pa.array(np.bincount(w.row[hit], minlength=t.rows)),
                        pa.array(np.bincount(w.row[hit], logs[at[hit]], t.rows)),
                        pa.array(bits * -np.log10(2)),
                        pa.array(bits / np.maximum(1, np.diff(t.ends))),
                        pa.ListArray.from_arrays(cut, pa.array(h[new].view(np.int64))),
                        pa.ListArray.from_arrays(cut, pa.array(times)),
                    ],
                    names,
                )
                uid += t.rows

    names = ["uid", "doc_id", "fold", "n_tokens", "hot", "hot_sum", "score", "bits_per_byte", "cold", "times"]
    schema = "uid long, doc_id long, fold long, n_tokens long, hot long, hot_sum double, score double, bits_per_byte double, cold array<long>, times array<long>"
    made = Stored(docs.select("doc_id", "text", F.col("fold").cast("long")).mapInArrow(run, schema), "lm-rows").df
    cold = made.select("uid", F.inline(F.arrays_zip(F.col("cold").alias("key"), "times")))
    cold = cold.join(vocab, "key").groupBy("uid").agg(F.sum("times").alias("some"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("some_sum"))
    per = float(np.log10(n_all + v_all + 1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return made.drop("cold", "times").join(cold, "uid", "left").select(
        "doc_id", (F.col("fold") == HELD).alias("held_out"), "n_tokens",
        (F.col("hot") + zero("some") + (1 if ends else 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + zero("some_sum") + float(np.log10(ends + 1)) - F.col("n_tokens") * per).alias("base_score"), "score", "bits_per_byte",
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return score(load(spark.read.parquet(f"{sf_dir}/documents.parquet")))
