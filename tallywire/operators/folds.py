"""Folds over a key's rows in order: what a row means depends on what the rows before it came to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(rows: DataFrame, key: str, order: list[str], start: Callable, schema: str, rows_out: int = 10_000) -> DataFrame:
    """What a walker of each key says to the key's rows, in order.

    start() makes a walker: a function of a row (without its key) that gives the rows to put out, and of None at the
    key's end. Rows are dealt out by key and sorted, never gathered: a task holds a batch and one walker, however long a
    key's history is. A null key is a key like others.
    """
    names = [key, *(c for c in rows.columns if c != key)]
    dealt = rows.select(*names).repartition(key).sortWithinPartitions(key, *order)
    kinds = rows.sparkSession.createDataFrame([], schema).limit(0).toArrow().schema

    def run(batches) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, walker = object(), None

        def batch():
            cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, kinds, strict=True)], kinds.names)

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if walker is None or k != now:
                    if walker is not None:
                        out.extend((now, *x) for x in walker(None))
                    now, walker = k, start()
                out.extend((k, *x) for x in walker(row))
                if len(out) >= rows_out:
                    yield batch()
                    out.clear()
        if walker is not None:
            out.extend((now, *x) for x in walker(None))
        yield batch()

    return dealt.mapInArrow(run, schema)
