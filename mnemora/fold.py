"""Ordered folds: a state per key that is carried through the sorted rows of the key.

Rows are dealt by key and sorted within their partitions, so the rows of a key come one after the
other, in batches of bounded size. A task holds one state and one batch, however long a history is;
there is no array per key, no limit and no second plan for long keys. The order of a fold is what
makes it sequential: the rows of one key go through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_OUT = 10_000


def fold_by_key(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], schema: str,
    step: Callable[[Any, tuple], Any], finish: Callable[[Any], tuple] | None = None,
    emit: Callable[[Any, tuple], tuple] | None = None,
) -> DataFrame:
    """``keys`` and the fields of ``schema``, by ``step(state, values)`` over the rows of a key in ``order``.

    The first state of a key is None. ``emit(state, values)`` gives a row after each step, ``finish(state)``
    one per key at its end; at least one of them is given. Rows that are equal in ``order`` come in no
    certain order, so it should hold a unique column. Null keys are keys like others.
    """
    spark = rows.sparkSession
    names = [*keys, *values]
    # As many partitions as the session shuffles into: rows that compress well would be merged into a few tasks, which sort them whole.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).select(*names)
    empty = spark.createDataFrame([], schema)
    types = rows.select(*keys).schema.fields + empty.schema.fields
    out_schema = type(empty.schema)(types)
    arrow, n = to_arrow_schema(out_schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun, out = None, None, False, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or row[:n] != key:
                    if begun and finish:
                        out.append((*key, *finish(state)))
                    key, state, begun = row[:n], None, True
                state = step(state, row[n:])
                if emit:
                    out.append((*key, *emit(state, row[n:])))
            if len(out) >= ROWS_OUT:
                yield _batch(out, arrow)
                out = []
        if begun and finish:
            out.append((*key, *finish(state)))
        yield _batch(out, arrow)

    return placed.mapInArrow(run, out_schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
