"""Vectors of integers in blocks: what the two clustering operators keep between their rounds.

A row of a state table is a block of vectors with the arrays that belong to them; its ``change`` column holds what the
block adds to the sums that the next round needs. So a round is one pass that reads a table and writes the next one, and
the sums come from a scan of one narrow column. Nothing depends on executors' disks: every table lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm.arrow import plain
from tabprep.sources.storage import discard, fresh_path

#: Vectors of one block. A memory setting, without effect on results.
BLOCK_ROWS = 8_192

Blocks = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def finite_vectors(rows: DataFrame, key: str, vector: str, **others: str) -> DataFrame:
    """(id long, vector array<double>, others) of the rows whose vector is not null and holds only finite numbers."""
    v = plain(vector).cast("array<double>")
    infinite = float("inf")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return rows.where(v.isNotNull() & ~bad).select(plain(key).cast("long").alias("id"), v.alias("vector"),
                                                   *(plain(c).alias(name) for name, c in others.items()))


def whole_numbers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long lists, one row each. Raises if a component leaves 32 bits."""
    flat = column.flatten().to_numpy()
    with np.errstate(over="ignore"):
        values = np.floor(scale * flat.astype(np.float64))
    if len(values) and np.abs(values).max() > 2**31 - 1:
        raise OverflowError(f"components times {scale} must fit 32 bits")
    return values.astype(np.int64).reshape(len(column), -1)


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances of integer rows, in floats where no sum passes 2**53 and in integers elsewhere."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * points.shape[1] * largest**2
    if bound < 2**53:
        points, entries = points.astype(np.float64), entries.astype(np.float64)
    elif bound >= 2**63:
        raise OverflowError("squared distances must fit 64 bits")
    cross = points @ entries.T
    cross *= -2
    cross += (points * points).sum(1)[:, None]
    cross += (entries * entries).sum(1)[None, :]
    return cross.astype(np.int64)


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Width and bytes of an integer array, in 16 bits a number where they suffice, else in 32."""
    width = 2 if not values.size or np.abs(values).max() < 2**15 else 4
    return width, values.astype(f"<i{width}").tobytes()


def unpacked(width: int, data: bytes, dimension: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dimension)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def one_list(values: pa.Array) -> pa.ListArray:
    """A list column of one row that holds the whole array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Rounds:
    """State tables of an iteration, each written by one pass over the one before, which is then deleted."""

    def __init__(self, spark: SparkSession, schema: str, label: str):
        self.spark, self.schema, self.label, self.path = spark, schema, label, None

    def step(self, source: DataFrame | None, run: Blocks) -> DataFrame:
        """Write the blocks that ``run`` makes of the source (or of the last state) and read them back."""
        last, path = self.path, fresh_path(self.spark, self.label)
        (source if source is not None else self.state()).mapInArrow(run, self.schema).write.parquet(path)
        self.path = path
        if last is not None:
            discard(self.spark, last)
        return self.state()

    def state(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def change(self, size: int) -> np.ndarray:
        """Sum of the ``change`` arrays of all blocks, added up by position before anything reaches the driver."""
        table = (self.state().select(F.posexplode("change").alias("pos", "value")).where("value <> 0")
                 .groupBy("pos").agg(F.sum("value").alias("value")).toArrow())  # as many rows as an array has numbers
        out = np.zeros(size, np.int64)
        out[table["pos"].to_numpy()] = table["value"].to_numpy()
        return out
