"""Registry of the queries over the given tables, each with its SQL if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.columns import col, replace_columns

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Round doubles, since two engines add them up in different orders."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)
             and (columns is None or f.name in columns)]
    return replace_columns(df, {c: F.round(col(c), digits) for c in names})


def null_when(condition: Column, c: str) -> Column:
    """The column with NULL where the condition holds: the given tables have no nulls."""
    return F.when(~condition, col(c))
