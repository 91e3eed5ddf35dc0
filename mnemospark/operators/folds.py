"""Folds in order that no aggregate can state: a state that each row of a group changes, one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(text))


def _run(rows: DataFrame, keys: list[str], order: list[str], walk: Callable[[Iterator[dict]], Iterator[dict]], result: str) -> DataFrame:
    schema = _schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in walk(row for batch in batches for row in batch.to_pylist()):
            held.append(row)
            if len(held) >= 8192:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, result)


def running_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], Any], out: Callable[[Any], dict], result: str) -> DataFrame:
    """Every row with what the state says after it. ``start`` makes a group's state of its first row, nulls sort first.

    Rows stream by sorted, one group after the other; a group of any size holds one state and no list.
    """

    def walk(stream: Iterator[dict]) -> Iterator[dict]:
        at, state = None, None
        for row in stream:
            key = tuple(row[k] for k in keys)
            if at != (key,):
                at, state = (key,), start(row)
            state = step(state, row)
            yield row | out(state)

    return _run(rows, keys, order, walk, result)


def last_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], Any], out: Callable[[dict, Any], dict], result: str) -> DataFrame:
    """One row for each group, made by ``out`` of its first row and of the state after its last."""

    def walk(stream: Iterator[dict]) -> Iterator[dict]:
        at, first, state = None, None, None
        for row in stream:
            key = tuple(row[k] for k in keys)
            if at != (key,):
                if at is not None:
                    yield out(first, state)
                at, first, state = (key,), row, start(row)
            state = step(state, row)
        if at is not None:
            yield out(first, state)

    return _run(rows, keys, order, walk, result)
