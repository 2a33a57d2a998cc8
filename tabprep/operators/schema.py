"""Column selection, alignment to a fitted schema, row and target rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.joins import salted_join
from tabprep.functions.columns import any_of, col, is_fractional, is_numeric, replace_columns

#: value of a missing column per family of the expected type
_EMPTY = {"int": 0, "float": 0.0, "bool": False}


def exclude_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    skip = set(names)
    return df.select(*[col(c) for c in df.columns if c not in skip])


def separate_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Feature names and the target. The rows are never split into two tables."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return [c for c in df.columns if c != target], target


def recombine_target(df: DataFrame, target: str) -> DataFrame:
    """Target column last."""
    features, _ = separate_target(df, target)
    return df.select(*[col(c) for c in features], col(target))


def align_raw(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fitted raw columns, in order; missing ones as NULL, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema])


def _family(dtype: str) -> str:
    name = dtype.lower()
    if name.startswith("bool"):
        return "bool"
    if name.startswith(("int", "uint", "bigint", "smallint", "tinyint", "long")):
        return "int"
    return "float"


def _spark_type(dtype: str) -> str:
    """Column type for a saved type name such as int64, float64 or bool."""
    known = {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint",
             "float64": "double", "float32": "float", "bool": "boolean"}
    return known.get(dtype.lower(), dtype.lower())


def align_schema(df: DataFrame, fields: Sequence[Mapping[str, str]]) -> DataFrame:
    """Align to ``[{name, dtype}]``: cast, fixed order, missing or null values 0 / 0.0 / False."""
    have = set(df.columns)
    out: list[Column] = []
    for f in fields:
        kind = _spark_type(f["dtype"])
        empty = F.lit(_EMPTY[_family(f["dtype"])]).cast(kind)
        value = F.coalesce(col(f["name"]).try_cast(kind), empty) if f["name"] in have else empty
        out.append(value.alias(f["name"]))
    return df.select(*out)


def finalize_output(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Only the fitted final columns, missing ones 0.0, the target appended if present."""
    have = set(df.columns)
    out = [(col(c) if c in have else F.lit(0.0)).alias(c) for c in columns if c != target]
    if target is not None and target in have:
        out.append(col(target))
    return df.select(*out)


def clean_infinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite, NaN and NULL numbers become 0."""
    names = set(df.columns if columns is None else columns)
    new = {}
    for f in df.schema:
        if f.name not in names or not is_numeric(f.dataType):
            continue
        zero = F.lit(0).cast(f.dataType)
        if is_fractional(f.dataType):
            bad = (F.abs(col(f.name)) == float("inf")) | F.isnan(col(f.name))
            new[f.name] = F.when(~bad, col(f.name)).otherwise(zero)
        else:
            new[f.name] = F.coalesce(col(f.name), zero)
    return replace_columns(df, new)


def drop_flag_columns(df: DataFrame, missing: bool = True, outlier: bool = True) -> DataFrame:
    gone = [c for c in df.columns
            if (missing and c == "Missing_Flag") or (outlier and c.startswith("Outlier_Flag"))]
    return df.drop(*gone)


def rows_with_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = df.columns if columns is None else columns
    return df.where(any_of([col(c).isNull() for c in names]))


def binarize_target(df: DataFrame, target: str, threshold: float = 0.5,
                    max_classes: int = 10) -> DataFrame:
    """A fractional target, or one with more than ``max_classes`` values, becomes 0/1."""
    continuous = is_fractional(df.schema[target].dataType)
    if not continuous:
        seen = df.select(col(target)).where(col(target).isNotNull()).distinct()
        continuous = seen.limit(max_classes + 1).count() > max_classes
    if not continuous:
        return df
    return replace_columns(df, {target: F.when(col(target) >= threshold, 1).otherwise(0)})


def keep_valid_classes(df: DataFrame, target: str, min_rows: int = 2) -> DataFrame:
    """Rows whose class has at least ``min_rows`` rows, for any number of classes.

    Valid classes come from a map-side combined count and are joined with salted keys.
    """
    valid = (df.groupBy(col(target).alias("__class")).agg(F.count("*").alias("__n"))
             .where((F.col("__n") >= min_rows) & F.col("__class").isNotNull()).select("__class"))
    return salted_join(df, valid, [target], ["__class"], "inner")
