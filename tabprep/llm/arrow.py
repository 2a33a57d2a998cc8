"""Arrow batches as numpy arrays, and the few column rules that all operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step of array work takes.
BLOCK_BYTES = 1 << 21


def plain(name: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the two columns an operator reads, as (doc_id long, text string); other columns never clash."""
    return docs.select(plain(key).cast("long").alias("doc_id"), plain(text).cast("string").alias("text"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def in_blocks(batches: Iterator[pa.RecordBatch], *text_columns: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row, so that arrays over bytes stay small."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    for k in text_columns)
        block = (np.cumsum(sizes) - 1) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-2))
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... one after the other."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def rows_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)
