"""Rows that follow each other with equal values, packed into one before they are shuffled.

Each batch of a task is packed by itself, so rows that do not follow each other stay single; nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _plain(column: pa.Array) -> list[np.ndarray]:
    """A column as arrays that can be compared: numbers, or codes of other values, and where it is null."""
    if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        column = column.dictionary_encode().indices
    if not column.null_count:
        return [column.to_numpy()]
    return [column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)]


def stretches(df: DataFrame, along: str, most: int) -> DataFrame:
    """The other columns with ``along`` (first), ``n`` and ``step``: rows with along, along + step ... along + (n - 1) step.

    Steps go from 1 to ``most``; ``along`` is a bigint and not null.
    """
    same = [c for c in df.columns if c != along]
    d = df.select(*same, along)
    schema = d.withColumns({"n": F.lit(1).cast("bigint"), "step": F.lit(1).cast("bigint")}).schema
    out = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column(len(same)).to_numpy()
            step = np.diff(y)
            new = (step < 1) | (step > most)
            for c in b.columns[:-1]:
                for v in _plain(c):
                    new |= v[1:] != v[:-1]
            # the second row of a stretch sets its step, the others keep it
            new[1:] |= (step[1:] != step[:-1]) & ~new[:-1]
            first = np.flatnonzero(np.r_[True, new])
            n = np.diff(np.r_[first, len(y)])
            by = np.where(n > 1, np.r_[step, 1][first], 1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in b.columns), pa.array(n, pa.int64()), pa.array(by, pa.int64())], schema=out)

    return d.mapInArrow(run, schema)
