"""Document-at-a-time Python behind Arrow batches, for what expressions can't say."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are Python values at once, and values (with those of lists, at any depth) that a batch of results holds.
SLICE, FLUSH = 64, 20_000


def weight(x: object) -> int:
    """How many values x is."""
    if isinstance(x, list) and x and isinstance(x[0], str | int):
        return 1 + len(x)
    if isinstance(x, list | tuple):
        return 1 + sum(map(weight, x))
    return len(x) if isinstance(x, dict) else 1


def release() -> None:
    """Gives a worker's free memory back to the system, which allocators keep otherwise; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, ddl: str, fn: Callable[..., Iterator[tuple]], begun: bool = False) -> DataFrame:
    """fn takes a row's values and yields rows of the schema in ddl; they leave in batches of about FLUSH values.

    With begun, fn() begins a task and gives what takes its rows.
    """
    schema = T._parse_datatype_string(ddl)
    target = to_arrow_schema(schema)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], target.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapped(batches)
        finally:
            release()

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, each = [], 0, fn() if begun else fn
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    for r in each(*row):
                        out.append(r)
                        held += sum(map(weight, r))
                        if held >= FLUSH:
                            yield made(out)
                            out, held = [], 0
        if out:
            yield made(out)

    return df.mapInArrow(run, schema)
