"""Table readers. NaN becomes NULL on the way in, so that one missing value exists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabprep.functions.columns import col, is_fractional, nan_to_null, replace_columns

#: extensions a table may be loaded from
FORMATS = ("csv", "txt", "json", "parquet")


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every float and double column."""
    new = {f.name: nan_to_null(col(f.name)) for f in df.schema if is_fractional(f.dataType)}
    return replace_columns(df, new) if new else df


def _checked(df: DataFrame, path: str) -> DataFrame:
    if not df.columns:
        raise ValueError(f"{path} holds no rows")
    return normalize_missing(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",", encoding: str = "UTF-8", timestamps_ntz: bool = True,
             multiline: bool = False) -> DataFrame:
    """Delimited text with a header. Give a schema for large inputs: inferring one scans twice.

    ``multiline`` allows line breaks inside quoted values, but then a file is not split.
    """
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
              .option("escape", '"').option("multiLine", multiline))
    if schema is not None:
        return _checked(reader.schema(schema).csv(path), path)
    df = reader.option("inferSchema", True).csv(path)
    if timestamps_ntz:
        df = df.select(*[
            col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType) else col(f.name) for f in df.schema])
    return _checked(df, path)


def read_txt(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = "\t") -> DataFrame:
    return read_csv(spark, path, schema, sep=sep)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              records_array: bool = False) -> DataFrame:
    """JSON lines (splittable), or with ``records_array`` files that each hold one array."""
    reader = spark.read.option("multiLine", records_array)
    if schema is not None:
        reader = reader.schema(schema)
    return _checked(reader.json(path), path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _checked(spark.read.parquet(path), path)


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_csv, "txt": read_txt, "json": read_json, "parquet": read_parquet}
    if kind not in FORMATS:
        raise ValueError(f"no reader for {kind} files")
    try:
        return readers[kind](spark, path, **options)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def validate_table(df: DataFrame, min_rows: int = 5) -> bool:
    """True with at least ``min_rows`` rows; reads no more rows than that."""
    return df.limit(min_rows).count() >= min_rows
