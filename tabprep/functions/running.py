"""Ordered work over a whole table without a single-partition window.

``bucketed`` numbers rows by range buckets of bounded size, monotone in the order columns, which are compared in their own
types: numbers, times and text alike. A value so frequent that it would overfill a bucket is split by the next order
column. Windows then run per bucket and small per-bucket totals carry over the borders.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabprep.functions.columns import col, small_table
from tabprep.sources.storage import stored

ROWS_PER_BUCKET = 1_000_000


def bucketed(df: DataFrame, order_columns: Sequence[str], rows_per_bucket: int | None = None,
             rows: int | None = None) -> tuple[DataFrame, list[Column]]:
    """``df`` with ``__bucket`` (bigint) and the sort order to use inside a bucket, NULLs last.

    Buckets are the partitions of a range repartitioning, so they are about even in size. Their numbers are written down
    with the rows: a task that runs again, with other borders, cannot mix two numberings.
    """
    order = [col(c).asc_nulls_last() for c in order_columns]
    n = df.count() if rows is None else rows
    pieces = math.ceil(n / (ROWS_PER_BUCKET if rows_per_bucket is None else rows_per_bucket))
    if pieces <= 1:
        return df.withColumn("__bucket", F.lit(0).cast("bigint")), order
    spread = df.repartitionByRange(pieces, *order).withColumn("__bucket", F.spark_partition_id().cast("bigint"))
    return stored(spread, "buckets"), order


def running_totals(df: DataFrame, order_column: str, sums: Mapping[str, str], descending: bool = True,
                   rows: int | None = None) -> DataFrame:
    """Add ``sums[name]`` = running total of column ``name`` in the given order.

    ``df`` holds one row per distinct order value (aggregate first): buckets are then even.
    """
    spread, _ = bucketed(df, [order_column], rows=rows)
    order = col(order_column).desc() if descending else col(order_column).asc()
    inside = (Window.partitionBy("__bucket").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = (spread.groupBy("__bucket").agg(*[F.sum(col(c)).alias(f"s{i}")
                                               for i, c in enumerate(sums)])
              .toArrow().to_pandas().sort_values("__bucket", ascending=not descending))
    before = np.vstack([np.zeros(len(sums)), totals.iloc[:, 1:].to_numpy(dtype=float)
                        .cumsum(axis=0)[:-1]]) if len(totals) else np.zeros((0, len(sums)))
    table = small_table(df.sparkSession, {
        "__bucket": pa.array(totals["__bucket"], pa.int64()),
        **{f"__o{i}": pa.array(before[:, i], pa.float64()) for i in range(len(sums))}})
    joined = spread.join(F.broadcast(table), "__bucket")
    kept = [col(c) for c in df.columns]
    new = [(F.sum(col(c)).over(inside) + F.col(f"__o{i}")).alias(out)
           for i, (c, out) in enumerate(sums.items())]
    return joined.select(*kept, *new)
