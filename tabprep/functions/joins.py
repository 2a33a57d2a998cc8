"""Joins of rows with a table that has one row for each key, safe for keys that hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.columns import col

#: copies of each key in the table; the rows of one key are dealt over as many tasks
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str | Column], named: Sequence[str],
                how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table`` whose columns ``named`` equal the ``keys``, NULL meeting NULL.

    ``table`` has one row for each key and its columns do not occur in ``rows``; the key columns of the table go.
    """
    whole = [col(f.name) for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType, T.UserDefinedType))]
    # a cross join, as Spark counts its copies when it chooses whether the table goes to every task; it ignores an explode
    copies = rows.sparkSession.range(SALTS).select(F.col("id").cast("int").alias("__copy"))
    salted = table.crossJoin(F.broadcast(copies))
    exprs = [col(k) if isinstance(k, str) else k for k in keys]
    keyed = rows.withColumns({f"__key{i}": k for i, k in enumerate(exprs)}
                             | {"__salt": F.pmod(F.xxhash64(*whole), F.lit(SALTS)).cast("int")})
    same = [F.col(f"__key{i}").eqNullSafe(col(n)) for i, n in enumerate(named)]
    joined = keyed.join(salted, reduce(lambda a, b: a & b, same, F.col("__salt") == F.col("__copy")), how)
    return joined.drop("__salt", "__copy", *[f"__key{i}" for i in range(len(exprs))], *named)
