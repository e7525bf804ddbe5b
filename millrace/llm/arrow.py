"""Arrow batches in Python workers: appending columns, and byte strings of text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a batch that Spark sends to a Python worker. Whole texts make batches large, and both sides hold several.
BATCH_BYTES = 4 << 20
#: Rows that one call handles, however large the batches are that Spark sends.
STEP = 1000


def texts(column: pa.Array, lower: bool = True) -> list[bytes]:
    """UTF-8 of a text column, null as empty; ``lower`` maps A-Z only."""
    found = column.cast(pa.large_binary()).to_pylist()
    # not Arrow's ascii_lower, which misreads sliced columns
    return [x.lower() if x else b"" for x in found] if lower else [x or b"" for x in found]


def steps(batches: Iterator[pa.RecordBatch], rows: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()  # workers stay, and Arrow keeps what it has freed


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to send batches of no more than BATCH_BYTES."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def append(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list], rows: int = STEP) -> DataFrame:
    """``df`` with further columns; ``make`` gets a batch and returns a list or array for each field.

    ``make`` may be a factory's result with state; it lives as long as the task."""
    schema = T.StructType([*df.schema.fields, *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, rows):
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(make(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return small_batches(df).mapInArrow(run, schema)
