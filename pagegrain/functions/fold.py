"""Ordered folds: the rows of a key, in order, through a small generator.

Spark deals rows by key and sorts them; a task then reads them once, one key after the
other, so there is no call overhead per key and memory holds what the step keeps. Keys
should be the smallest independent unit; a step that reads its rows as they come may take a long
page whole, if it holds only what hangs together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 8192


def fold(df: DataFrame, keys: Sequence[str], order: Sequence, step: Callable[[tuple, Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``step(key, rows)`` yields the result rows of a key; ``rows`` are tuples of all columns of ``df`` but the keys.

    ``order`` sorts the rows of a key and should leave no ties. Null is a key like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    out = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    def run(batches):
        found: list[tuple] = []
        for key, members in groupby(rows(batches), key=lambda r: r[:n]):
            for row in step(key, (r[n:] for r in members)):
                found.append(row)
                if len(found) == BATCH:
                    yield made(found)
                    found = []
        if found:
            yield made(found)

    return dealt.mapInArrow(run, schema)
