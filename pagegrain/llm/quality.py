"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a bounded sample of labelled documents (at most ``SAMPLE``, those of the
smallest hash, the same at every input size) are binned by quantiles; complete trees are
grown level by level from gradient histograms, and stored as flat arrays that all rows
of a batch walk at once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pagegrain.llm.common import held_out, load

SAMPLE = 16_000
TREES, DEPTH, BINS, RATE, LEAST = 80, 4, 64, 0.15, 4.0
CUT = 0.7

NAMES = (
    "chars words word_len symbols stops digits upper blanks wide distinct top lines dup_lines line_len "
    "closed short pairs bangs bars entropy runs letters title"
).split()
_CLASS = np.zeros((9, 256), np.float64)
for _k, _s in enumerate(("#*$%&|<>", ".,;:?", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\r\x0b\x0c", "", "!", "|", "abcdefghijklmnopqrstuvwxyz")):
    _CLASS[_k, [ord(c) for c in _s]] = 1
_CLASS[5, 128:] = 1


def statistics(text: str | None) -> list[float]:
    """The numbers of ``NAMES``; all 0 for an empty or null text."""
    if not text:
        return [0.0] * len(NAMES)
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = hist.sum()
    share = _CLASS @ hist / size
    p = hist[hist > 0] / size
    words = text.split()
    n = len(words)
    w = max(1, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    return [
        np.log1p(size), np.log1p(n), (size - share[4] * size) / w, share[0], share[1], share[2], share[3], share[4], share[5],
        len(counts) / w, max(counts.values(), default=0) / w, np.log1p(len(lines)), 1 - len(set(lines)) / m, np.log1p(size / m),
        sum(x.rstrip().endswith((".", "!", "?", ":")) for x in lines) / m, sum(map((3).__ge__, map(len, words))) / w, pairs,
        share[6], share[7], -(p * np.log2(p)).sum(), sum(map(str.__eq__, words, words[1:])) / w, share[8],
        sum(map(str.istitle, words)) / w,
    ]


class Forest:
    """Trees as arrays: tests of inner nodes in heap order, then leaf values."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees = np.arange(len(self.feature))
        total = np.full(len(x), self.base)
        if len(trees):
            rows = np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            total += self.leaf[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boost logistic loss. Ties between splits: the first feature, then the lowest cut."""
    n, f = x.shape if len(x) else (0, len(NAMES))
    prior = np.log((y.sum() + 1) / (n - y.sum() + 1)) if n else 0.0
    none = np.zeros((0, 2**DEPTH - 1))
    if n < 2 or y.min() == y.max():
        return Forest(float(prior), none.astype(int), none, np.zeros((0, 2**DEPTH)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(n, prior)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for d in range(DEPTH):
            k = 2**d
            gh = np.empty((2, f, k, BINS))
            for j in range(f):
                at = node * BINS + binned[j]
                gh[0, j] = np.bincount(at, g, k * BINS).reshape(k, BINS)
                gh[1, j] = np.bincount(at, h, k * BINS).reshape(k, BINS)
            left = gh.cumsum(-1)
            all_ = left[..., -1:]
            right = all_ - left
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - all_[0] ** 2 / (all_[1] + 1)
            gain[(left[1] < LEAST) | (right[1] < LEAST)] = 0
            best = gain.transpose(1, 0, 2).reshape(k, -1)
            at = best.argmax(1)
            ok = best[np.arange(k), at] > 1e-6
            j, b = at // BINS, at % BINS
            go = np.zeros(n, bool)
            for q in np.flatnonzero(ok):
                here = node == q
                go[here] = binned[j[q]][here] > b[q]
                feature[k - 1 + q], cut[k - 1 + q] = j[q], edges[j[q]][min(b[q], len(edges[j[q]]) - 1)]
            node = 2 * node + go
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        leaf = -RATE * gs / (hs + 1)
        margin += leaf[node]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Forest(float(prior), np.array(features), np.array(cuts), np.array(leaves))


def measured(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``text`` replaced by its statistics."""
    keep = [c for c in docs.columns if c != text]
    k = docs.columns.index(text)
    schema = StructType([*docs.select(*keep).schema.fields, StructField(out, ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            got = pa.array([statistics(t.as_py()) for t in batch.column(k)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), got], [*keep, out])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Learn from at most ``most`` labelled documents; null labels and ids teach nothing."""
    labels = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    labels = labels.where(~held_out("doc_id", 4))
    n = labels.count()
    if not n:
        return grow(np.zeros((0, len(NAMES))), np.zeros(0))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    within = F.pmod(key, F.lit(1 << 30)) < int(min(1.0, 1.2 * most / n) * (1 << 30))
    some = docs.where(within).join(labels.where(within), "doc_id")
    some = measured(some.select("doc_id", "y", "text")).orderBy(key, "doc_id", "y").limit(most).collect()
    return grow(np.array([r.stats for r in some]).reshape(-1, len(NAMES)), np.array([r.y for r in some]))


def classify(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of rows with doc_id and text."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = forest.score(np.array([statistics(t.as_py()) for t in batch.column(2)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names)

    names = ["doc_id", "held_out", "score", "predicted"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id", 4).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = load(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
