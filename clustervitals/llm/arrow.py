"""Arrow batches of documents inside tasks: raw bytes, bounded slices, appended columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# Texts handled together in a task, in bytes; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


# Rows in an Arrow batch; Spark's default of 10,000 whole texts is much for a small executor.
BATCH_ROWS = 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Bytes in one, about, which count where rows are long; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of a batch for the session, unless they are bounded already."""
    if int(spark.conf.get(_ROWS_SETTING)) > BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))
    plain = spark.conf.get(_BYTES_SETTING).removesuffix("b")
    if plain.isdecimal() and int(plain) > BATCH_BYTES:
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 bounds of its values; a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0]), bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string column from UTF-8 bytes and the n + 1 bounds of its values."""
    made = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]
    )
    return made.cast(pa.string())


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that the texts of a slice stay near ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for start, end in zip(cuts[:-1], cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def appended(batch: pa.RecordBatch, drop: list[str], **columns) -> pa.RecordBatch:
    """The batch without the columns ``drop`` and with further ones."""
    kept = [i for i, name in enumerate(batch.schema.names) if name not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in kept] + [pa.array(v) if not isinstance(v, pa.Array) else v for v in columns.values()],
        [batch.schema.names[i] for i in kept] + list(columns),
    )
