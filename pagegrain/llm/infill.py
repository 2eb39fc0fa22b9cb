"""Fill-in-middle: a document's middle moves behind its prefix and suffix.

A text is cut into units, runs of ASCII letters or single other code points. Every batch
goes through ``pyarrow.compute``: a byte that UTF-8 never has is put behind each unit, the
text is split there into a list array, the lists are flattened with their parent indices,
a unit's ordinal says which of the three parts it belongs to, and each part is filtered out,
rebuilt as lists and joined. A text over ``SLICE_BYTES`` is cut between two units first,
counted, and then moved piece by piece, so that lists never hold more than one slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import SLICE_BYTES, load, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_UNDER = 90, 20
_UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFE][\x80-\xBF]*"
_END = b"\xff"
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def dice(doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the hash of a document, as integers; a null id counts as empty."""
    sha = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def units(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lists of the units of binary rows, each with an empty one at its end, and how many units they have."""
    marked = pc.replace_substring_regex(rows, pattern=_UNIT, replacement=rb"\0" + _END)
    lists = pc.split_pattern(marked, pattern=_END)
    return lists, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1


def parts(lists: pa.Array, before: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each row: units under ``first``, under ``last``, and the rest.

    ``before`` is the ordinal of a row's first unit.
    """
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ordinal = np.arange(len(flat)) - starts[parent] + before[parent]
    role = (ordinal >= first[parent]).astype(np.int8) + (ordinal >= last[parent])
    out = []
    for k in range(3):
        mine = role == k
        offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[mine], minlength=len(lists)))])
        rebuilt = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(mine)))
        out.append(pc.binary_join(rebuilt, b""))
    return out


def _cuts(n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _pieces(data: np.ndarray, most: int):
    """Ranges of about ``most`` bytes that begin and end between two units."""
    at = 0
    while at < len(data):
        to = at + most
        while to < len(data) and (_LETTER[data[to - 1]] or 0x80 <= data[to] < 0xC0):
            to += 1
        yield at, min(to, len(data))
        at = to


def _long(data: np.ndarray, h: np.ndarray, most: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of units and the parts of one text that is cut into pieces."""
    ranges = list(_pieces(data, most))
    piece = lambda a, b: pa.array([data[a:b].tobytes()], pa.binary())
    counts = np.array([pc.count_substring_regex(piece(a, b), pattern=_UNIT)[0].as_py() for a, b in ranges], np.int64)
    n = counts.sum(keepdims=True)
    first, last = _cuts(n, h)
    found: list[list[bytes]] = [[], [], []]
    for (a, b), before in zip(ranges, np.cumsum(counts) - counts):
        for k, got in enumerate(parts(units(piece(a, b))[0], np.array([before]), first, last)):
            found[k].append(got[0].as_py())
    return n, [pa.array([b"".join(x)], pa.binary()) for x in found]


def _moved(rows: pa.Array, doc_id: pa.Array, h: np.ndarray, most: int) -> pa.RecordBatch:
    """The result for binary texts without null."""
    if len(rows) == 1 and len(rows[0].as_buffer()) > most:
        n, (p, m, s) = _long(np.frombuffer(rows[0].as_buffer(), np.uint8), h, most)
    else:
        lists, n = units(rows)
        p, m, s = parts(lists, np.zeros(len(n), np.int64), *_cuts(n, h))
    text, p, m, s = (x.cast(pa.string()) for x in (rows, p, m, s))
    plain = pc.or_(pc.match_substring_regex(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), pa.array((n == 0) | (h[:, 2] % 100 >= PLAIN_FROM)))
    spm = pa.array(h[:, 3] % 100 < SPM_UNDER)
    moved = pc.if_else(spm, pc.binary_join_element_wise(SUFFIX, s, PREFIX, p, MIDDLE, m, ""), pc.binary_join_element_wise(PREFIX, p, SUFFIX, s, MIDDLE, m, ""))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (p, m)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n), form, *chars, pc.if_else(plain, text, moved)], NAMES)


def transform(docs: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of ``docs`` (doc_id, text).

    Null text is empty, and an empty one plain; equal rows give equal results, as the
    choices follow the id; any other column is left behind; an empty table gives none.
    """
    rows = load(docs)
    rows = rows.select("doc_id", "text", *(x.alias(f"h{k}") for k, x in enumerate(dice(F.col("doc_id")))))

    def run(batches):
        for batch in batches:
            h = np.stack([batch.column(2 + k).to_numpy() for k in range(4)], 1)
            for t in texts(batch.column(1), most):
                at = slice(t.first, t.first + t.rows)
                offsets, data = pa.py_buffer(t.ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(t.data))
                slice_ = pa.Array.from_buffers(pa.binary(), t.rows, [None, offsets, data])
                yield _moved(slice_, batch.column(0)[at], h[at], most)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the text has none of the marks
    get = lambda *k: F.concat(*(F.get(part, F.lit(i)) for i in k))
    return F.when(form == "psm", get(1, 3, 2)).when(form == "spm", get(2, 3, 1)).otherwise(output)


def op12(spark, sf_dir: str) -> DataFrame:
    d = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return d.select(*NAMES[:5], sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
