"""Small Column helpers: quoting, type families, NaN handling, lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: up to this many entries a lookup is written as a literal map in the plan
LITERAL_ENTRIES = 64


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, whatever spaces or dots it has."""
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    family = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, family) and f.name not in skip]


def non_numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Everything an encoder may treat as a category: text, flags, dates, timestamps."""
    skip = set(exclude)
    family = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, family) and f.name not in skip]


def as_double(name: str) -> Column:
    return col(name).cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL: in every count, fill and flag both are missing."""
    return nan_to_null(col(name)) if is_fractional(df.schema[name].dataType) else col(name)


def number(name: str) -> Column:
    """The column as a double, NaN as NULL."""
    return nan_to_null(as_double(name))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def add_all(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def flag(condition: Column) -> Column:
    """Condition as 0/1, with unknown counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_1``, ``name_2``, ... if it is already taken."""
    taken = set(taken)
    if name not in taken:
        return name
    i = 1
    while f"{name}_{i}" in taken:
        i += 1
    return f"{name}_{i}"


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or append columns in one projection, keeping the column order."""
    names = df.columns
    kept = [new[c].alias(c) if c in new else col(c) for c in names]
    added = [v.alias(k) for k, v in new.items() if k not in names]
    return df.select(*kept, *added)


def literal_map(mapping: Mapping, value_type: str) -> Column:
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v).cast(value_type)]
    return F.create_map(*pairs)


def small_table(spark: SparkSession, columns: Mapping[str, pa.Array]) -> DataFrame:
    """A driver-side parameter table as a local relation."""
    return spark.createDataFrame(pa.table(dict(columns)))


def lookup(df: DataFrame, source: Column, mapping: Mapping[str, float], out: str,
           value_type: str = "double") -> DataFrame:
    """Add ``out`` = mapping[source] (NULL when absent).

    Few entries become a literal map; more become a broadcast join with a local relation, whose
    size the caller has already bounded by holding ``mapping`` on the driver.
    """
    if not mapping:
        return df.withColumn(out, F.lit(None).cast(value_type))
    if len(mapping) <= LITERAL_ENTRIES:
        return df.withColumn(out, F.try_element_at(literal_map(mapping, value_type), source))
    spark = df.sparkSession
    arrow = {"double": pa.float64(), "int": pa.int32()}[value_type]
    table = small_table(spark, {
        "__key": pa.array(list(mapping.keys()), pa.string()),
        out: pa.array(list(mapping.values()), arrow),
    })
    keyed = df.withColumn("__lookup", source)
    joined = keyed.join(F.broadcast(table), keyed["__lookup"] == table["__key"], "left")
    return joined.drop("__lookup", "__key")
