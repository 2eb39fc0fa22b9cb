"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* N-grams of 1 to 3 characters of the lower-cased text, everything but letters as one
  space, hashed into ``BUCKETS``. Document frequencies come from every training document.
* Weights: follow-the-regularised-leader with an elastic net, on a bounded sample of at
  most ``PER_LANG`` labelled documents of each language, the same at every input size.
* Temperature: fitted on every fifth document of that sample, kept out of the training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pagegrain.llm.common import give_back, held_out

BITS = 14
BUCKETS = 1 << BITS
PER_LANG = 700
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters (general category L)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's n-grams; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    if (c == 32).all():
        return None
    shift = np.uint32(32 - BITS)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    tf = np.zeros(BUCKETS, np.int64)
    for k, h in ((3, one[1:-1]), (5, two), (7, three)):
        tf += np.bincount((h * np.uint32(2 * k + 0x9E3779B1)) >> shift, minlength=BUCKETS)
    at = np.flatnonzero(tf)
    return at, tf[at]


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[at]
    return x / np.sqrt((x * x).sum())


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with letters, and in how many each bucket occurs; the result has a fixed size."""

    def run(batches):
        n, df = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                got = ngrams(text.as_py())
                if got:
                    n += 1
                    df[got[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in rows.collect():  # at most BUCKETS + 1 rows
        df[bucket] = n
    return int(df[-1]), df[:-1]


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most ``per_lang`` labelled documents of each language, those of the smallest hash."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    counts = docs.groupBy("lang").count().collect()  # a row per language
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_lang / n + 0.0001))).otherwise(share)
    some = docs.withColumn("_key", key).where(F.pmod("_key", F.lit(1 << 30)) < share * (1 << 30))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("_key", "doc_id"))
    return some.withColumn("_nth", nth).where(F.col("_nth") <= per_lang)


def _features(rows: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    def run(batches):
        for batch in batches:
            out = []
            for lang, nth, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                got = ngrams(text)
                if got:
                    out.append((lang, nth, got[0].astype("<u2").tobytes(), got[1].astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "nth", "at", "tf"])

    got = rows.select("lang", F.col("_nth").cast("long").alias("nth"), "text").mapInArrow(run, "lang string, nth long, at binary, tf binary")
    return sorted((r.lang, r.nth, np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.tf, "<f4")) for r in got.collect())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes, BUCKETS + 1); the last column is the bias. One online pass per epoch."""
    z = np.zeros((classes, BUCKETS + 1))
    n = np.zeros_like(z)

    def leader(at):
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2)), nn

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w, nn = leader(at)
            p = softmax(w @ x)
            p[y] -= 1
            g = p[:, None] * x
            new = nn + g * g
            z[:, at] += g - (np.sqrt(new) - np.sqrt(nn)) / ALPHA * w
            n[:, at] = new
    return leader(np.arange(BUCKETS + 1))[0]


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Languages, inverse document frequencies, weights and temperature: a fixed size per language."""

    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, t: float):
        self.langs, self.idf, self.w, self.t = langs, idf, w, t

    def predict(self, text: str | None) -> tuple[str, float]:
        got = ngrams(text)
        if got is None or not self.langs:
            return UNKNOWN, 0.0
        at, tf = got
        p = softmax((self.w[:, at] @ weighted(at, tf, self.idf) + self.w[:, -1]) / self.t)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): rows with a null language teach nothing."""
    docs = docs.where("lang is not null")
    n, df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = _features(sample(docs, per_lang))
    langs = sorted({r[0] for r in rows})
    index = {lang: i for i, lang in enumerate(langs)}
    rows.sort(key=lambda r: (r[1], r[0]))  # the languages take turns
    data = [(at, weighted(at, tf, idf), index[lang]) for lang, _, at, tf in rows]
    last = [r for (_, nth, _, _), r in zip(rows, data) if nth % 5 == 0]
    w = ftrl([r for (_, nth, _, _), r in zip(rows, data) if nth % 5], len(langs))
    logits = np.array([w[:, at] @ x + w[:, -1] for at, x, _ in last]).reshape(-1, max(1, len(langs)))
    return Model(langs, idf, w, temperature(logits, np.array([y for *_, y in last], int)))


def identify(docs: DataFrame, model: Model, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the language and its probability to rows with a ``text``; other columns stay."""
    schema = StructType([*docs.schema.fields, StructField(out[0], StringType()), StructField(out[1], DoubleType())])
    k = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(k)]
            got = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], names)
        give_back()

    names = [*docs.columns, *out]
    return docs.mapInArrow(run, schema)


def learn_and_identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Null text, no letter, or nothing to learn from: ``und`` with score 0. Repeated rows
    are predicted each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(rows.where(~held_out("doc_id", 4)))
    out = identify(rows.select("doc_id", "text", held_out("doc_id", 4).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    return learn_and_identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
