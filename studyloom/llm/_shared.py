"""What the operators of this subpackage share: words, batches, shared folders, checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import cut, shared_dir

__all__ = ["append", "bucket_of", "cut", "lower_words", "pieces", "released", "shared_dir", "small_side", "table", "unused", "utf8", "written"]

#: Bytes that are no part of a word become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
_LOWER_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty; lone surrogates can't come from Spark strings."""
    return (text or "").encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased; null has none."""
    return utf8(text).translate(_LOWER_WORDS).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: str) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % 5


def written(df: DataFrame) -> DataFrame:
    """As cut, but kept as a compressed table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Hints a broadcast only if the (already computed) rows are counted to be few; else the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


Batch = pa.RecordBatch
PIECE_CHARS = 1 << 20
#: Rows of a batch that are Python values at once.
PIECE_ROWS = 1_000


def unused(name: str, taken: Sequence[str]) -> str:
    """name, or with marks behind it, such that no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def fields_of(ddl: str) -> list[T.StructField]:
    return T._parse_datatype_string(ddl).fields


def append(df: DataFrame, ddl: str, make: Callable[[], Callable[[Batch], Sequence]], drop: Sequence[str] = (), piece_by: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """df with new columns. make() runs once a task and returns a function from a batch to the new columns.

    Batches are worked on in pieces of piece_rows rows or, with piece_by, a text column, of about PIECE_CHARS
    characters. A column of df with the name of a new one is replaced. Columns in drop are inputs that don't come back.
    """
    new = fields_of(ddl)
    names = {f.name for f in new}
    back = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType(back + new)
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in new]

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        fn = make()
        try:
            for whole in batches:
                rows = whole.num_rows
                parts = pieces(whole.column(whole.schema.get_field_index(piece_by)).to_pylist(), PIECE_CHARS) if piece_by else [(a, min(rows, a + piece_rows)) for a in range(0, rows, piece_rows)]
                for a, b in parts if rows else ():
                    batch = whole.slice(a, b - a)
                    kept = [batch.column(batch.schema.get_field_index(f.name)) for f in back]
                    made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(fn(batch), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(kept + made, [f.name for f in back + new])
        finally:  # a worker outlives its task: what the task has gathered goes
            getattr(fn, "close", int)()
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives a worker's free memory back to the system, which allocators keep otherwise; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """run, a function of batches, with release() behind it."""

    def wrapped(batches: Iterator[Batch]) -> Iterator[Batch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def pieces(texts: list, limit: int, size: Callable = len) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose sizes sum to about limit, one text at least."""
    start = total = 0
    for i, x in enumerate(texts):
        total += size(x) if x is not None else 0
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
