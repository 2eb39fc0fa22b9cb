"""Token-id files as directly addressable codes.

Each id is split into 8-bit levels. Level k holds a byte for every id that needs it, a
bitmap that tells which of these ids go on to level k+1, and a rank directory over that
bitmap. The place of an id on the next level is its rank, so any token is read with
one look-up per level and no block is decoded.

A file holds whole documents: magic, header (JSON: counts and array sizes), document
ids, null marks, first token of each document, then the levels. All little-endian.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagegrain.llm.common import give_back, load
from pagegrain.llm.tokens import crc32_of, encoder, slices, vocabulary
from pagegrain.sources.scratch import materialize, new_path

MAGIC = b"DACIDS01"
WORDS_PER_SUPER = 512
FILE_TOKENS = 4_000_000
DECODE = 1 << 19


class Ranked:
    """A bitmap of 64-bit words with counts of ones before each super block and word."""

    def __init__(self, words: np.ndarray, supers: np.ndarray, subs: np.ndarray):
        self.words, self.supers, self.subs = words, supers, subs

    @classmethod
    def of(cls, bits: np.ndarray) -> Ranked:
        n = -(-len(bits) // 64)
        packed = np.zeros(n * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        words = packed.view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        supers = before[::WORDS_PER_SUPER].copy()
        return cls(words, supers, (before - np.repeat(supers, WORDS_PER_SUPER)[:n]).astype("<u2"))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        below = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.supers[w // WORDS_PER_SUPER] + self.subs[w] + np.bitwise_count(below)


def levels_of(ids: np.ndarray) -> list[tuple[np.ndarray, Ranked | None]]:
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        ranked = Ranked.of(more) if more.any() else None
        out.append(((rest & 0xFF).astype(np.uint8), ranked))
        if ranked is None:
            return out
        rest = rest[more] >> 8


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents; ``starts`` has the first token of each and the total."""
    arrays = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], np.uint8),
        np.asarray(starts, "<i8"),
    ]
    levels = levels_of(ids)
    for chunk, ranked in levels:
        arrays.append(chunk)
        if ranked:
            arrays += [ranked.words, ranked.supers.astype("<i8"), ranked.subs]
    head = json.dumps({"levels": len(levels), "sizes": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in arrays)])


class DacFile:
    """Random access to the tokens and documents of a file's bytes."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        at = 16 + int.from_bytes(raw[8:16], "little")
        head = json.loads(bytes(raw[16:at]))
        arrays = []
        for kind, n in head["sizes"]:
            kind = np.dtype(kind)
            arrays.append(np.frombuffer(raw, kind, n, at))
            at += kind.itemsize * n
        self.doc_ids, self.nulls, self.starts = arrays[:3]
        rest, self.levels = iter(arrays[3:]), []
        for k in range(head["levels"]):
            chunk = next(rest)
            ranked = Ranked(next(rest), next(rest), next(rest)) if k + 1 < head["levels"] else None
            self.levels.append((chunk, ranked))

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The ids at any places, each read by itself."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        of = np.arange(len(at))
        for k, (chunk, ranked) in enumerate(self.levels):
            out[of] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            if ranked is None:
                break
            more = ranked.get(at)
            of, at = of[more], ranked.rank(at[more])
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first token in the file and ids of each document."""
        n, i = len(self.doc_ids), 0
        while i < n:
            to = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + DECODE, "right")) - 1)
            to = min(to, n)
            got = self.tokens(np.arange(self.starts[i], self.starts[to]))
            for d in range(i, to):
                a, b = self.starts[d] - self.starts[i], self.starts[d + 1] - self.starts[i]
                yield (None if self.nulls[d] else int(self.doc_ids[d])), int(self.starts[d]), got[a:b]
            i = to


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_ids(docs: DataFrame, folder: str, vocab: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the token ids of ``docs`` (doc_id, text) to files in ``folder``; return the manifest.

    Documents lie in ascending doc_id order (null first): the range partitions follow
    the order, and each task writes its documents in order to files of about
    ``file_tokens`` ids. Every try of a task writes files of its own names, and only those
    named in the manifest count, so a lost executor leaves nothing wrong behind.
    Null text: only the end id. Repeated ids stay next to each other.
    """
    vocab = vocab or vocabulary()

    def run(batches):
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        fs, base = _fs(folder)
        enc = encoder(vocab)
        ids, parts, total = [], [], 0

        def flush():
            nonlocal ids, parts, total, seq
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
            name = f"{base}/ids-{shard:06d}-{seq:06d}-{uuid.uuid4().hex[:8]}.dac"
            with fs.open_output_stream(name) as out:
                out.write(to_bytes(ids, starts, np.concatenate(parts)))
            row = {"shard": [shard], "seq": [seq], "name": [name.rsplit("/", 1)[1]], "n_docs": [len(ids)], "n_ids": [int(starts[-1])]}
            ids, parts, total, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=MANIFEST)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc_id, got in zip(keys[a:b], enc.ids(texts[a:b])):
                    ids.append(doc_id)
                    parts.append(got)
                    total += len(got)
                    if total >= file_tokens:
                        yield flush()
        if ids:
            yield flush()
        give_back()

    _fs(folder)[0].create_dir(_fs(folder)[1], recursive=True)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(docs.doc_id.cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "shard long, seq long, name string, n_docs long, n_ids long")


MANIFEST = pa.schema([("shard", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The window below sees one small row per file.
    """
    before = W.orderBy("shard", "seq").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches):
        fs, base = _fs(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as f:
                    file = DacFile(f.read_buffer())
                rows = [(d, first + s, len(x), crc32_of(x)) for d, s, x in file.documents()]
                yield pa.RecordBatch.from_pydict(dict(zip(_READ.names, map(list, zip(*rows)))), schema=_READ)

    n = max(1, manifest.count())
    return files.repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = load(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = new_path(spark, "token-ids")
    return read_ids(materialize(write_ids(docs, folder), "token-manifest"), folder)
