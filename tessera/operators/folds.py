"""Recurrences over ordered rows that windows can't state: one pass over sorted rows, with a small state for each key.

Rows are dealt by key and sorted in their partitions by Spark, which spills; a task then reads them in Arrow batches and
holds one batch and one state, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_NO_KEY = object()


def _in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def annotated(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], inputs: Sequence[str], start: Callable[[], Any], step: Callable[..., Any], name: str, kind: str) -> DataFrame:
    """Adds the column ``name``: what ``step(state, *inputs)`` returns for each row; ``start()`` is a key's first state."""
    added = StructType.fromDDL(f"`{name}` {kind}")
    arrow = to_arrow_schema(added).field(0).type
    schema = StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = _NO_KEY, None
        for batch in batches:
            of_rows = zip(*(batch.column(k).to_pylist() for k in keys))
            out = []
            for own, *values in zip(of_rows, *(batch.column(c).to_pylist() for c in inputs)):
                if own != key:
                    key, state = own, start()
                out.append(step(state, *values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return _in_order(rows, keys, order).mapInArrow(run, schema)


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], inputs: Sequence[str], start: Callable[[], Any], schema: str) -> DataFrame:
    """(keys, ``schema``): what the states give.

    A key's state is made by ``start()``; ``add(*inputs)`` takes each row and ``end()`` comes after the last, and both give
    rows of ``schema``.
    """
    result = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(result)
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = _NO_KEY, None

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            of_rows = zip(*(batch.column(k).to_pylist() for k in keys))
            out: list[tuple] = []
            for own, *values in zip(of_rows, *(batch.column(c).to_pylist() for c in inputs)):
                if own != key:
                    if state is not None:
                        out += [(*key, *x) for x in state.end()]
                    key, state = own, start()
                out += [(*own, *x) for x in state.add(*values)]
            if out:
                yield made(out)
        if state is not None and (out := [(*key, *x) for x in state.end()]):
            yield made(out)

    return _in_order(rows.select(*dict.fromkeys([*keys, *inputs, *(c for c in order if isinstance(c, str))])), keys, order).mapInArrow(run, result)
