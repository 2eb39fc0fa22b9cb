"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents of one length are interchangeable, so the packing is worked out on the number
of documents of each length (at most one number per length, however many documents there
are) and each document then finds its place from its length and its rank in that length.

* Lengths over a third of the capacity: at most two fit in a sequence. From the longest
  down, each is matched with the longest other that still fits.
* The rest, from the longest down, each into the smallest gap that holds it; a new
  sequence only where no gap does.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import give_back, load
from pagegrain.llm.tokens import crc32_of, encoder, slices, vocabulary
from pagegrain.sources.scratch import materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), by length and rank.

    Ranks ``first .. first + how_many - 1`` of a length go to as many consecutive
    sequences, all at the same offset.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted, each once
    bins: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    made = 0

    def put(length: int, many: int, seq: int, offset: int) -> None:
        rows.append((length, used[length], many, seq, offset))
        used[length] += many
        left[length] -= many

    def free(gap: int, seq: int, many: int) -> None:
        if gap and many:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append((seq, many))

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            b = large[at] if at >= 0 else None
            if b is None or (b == a and left[a] == 1):
                b = next((x for x in reversed(large[:at]) if left[x]), None) if b == a else None
            many = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, many, made, 0)
            if b is not None:
                put(b, many, made, a)
            free(capacity - a - (b or 0), made, many)
            made += many

    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                full, over = divmod(left[a], each)
                for many, items in ((full, each), (1, over)):
                    if many and items:
                        for i in range(items):
                            put(a, many, made, i * a)
                        free(capacity - items * a, made, many)
                        made += many
                break
            gap = gaps[at]
            seq, many = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[at]
            take = min(many, left[a])
            put(a, take, seq, capacity - gap)
            free(gap - a, seq, take)
            free(gap, seq + take, many - take)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut: only longer documents are cut, and the first piece may be shorter.

    ``part`` and ``nth`` number the pieces of a length within the task that made them.
    """

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(vocab)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                for doc_id, ids in zip(keys[i:j], enc.ids(texts[i:j])):
                    at = len(ids) % capacity or capacity
                    cuts = [0, *range(at, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc_id, k, a, b - a, crc32_of(ids[a:b]), part, int(seen[b - a])))
                        seen[b - a] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        give_back()

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one piece with the end id alone. Repeated rows are packed each.
    The pieces are written once, so that the numbers within a task stay as they are.
    """
    made = materialize(pieces(docs, vocab or vocabulary(), capacity), "pieces")
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row per length
    rows = plan(totals, capacity)
    key = rows[:, 0] << 44 | rows[:, 1]
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = cols["length"].to_numpy(), cols["rank"].to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            found = [rows[at, 3] + rank - rows[at, 1], rows[at, 4]]
            kept = [cols[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], out)

    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(load(spark.read.parquet(f"{sf_dir}/documents.parquet")))
