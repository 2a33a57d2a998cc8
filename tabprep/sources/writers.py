"""Table writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabprep.functions.columns import col

#: microseconds are kept in text formats
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
         "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8",
              header: bool = True, mode: str = "errorifexists") -> str:
    (df.write.mode(mode).options(**TIMES).option("header", header).option("sep", sep)
     .option("encoding", encoding).option("escape", '"').csv(path))
    return path


def write_txt(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists") -> str:
    return write_csv(df, path, sep=sep, mode=mode)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One JSON object per line; absent fields stay visible as nulls."""
    df.write.mode(mode).options(**TIMES).option("ignoreNullFields", False).json(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_split(df: DataFrame, path: str, split_column: str = "split",
                mode: str = "errorifexists") -> str:
    """Train and test part as one dataset partitioned by the split column, in one pass."""
    df.write.mode(mode).partitionBy(split_column).parquet(path)
    return path


def write_features_and_target(df: DataFrame, path: str, target: str,
                              mode: str = "errorifexists") -> tuple[str, str]:
    """Features and target as two datasets, ``X`` and ``y``."""
    x, y = f"{path}/X", f"{path}/y"
    df.drop(target).write.mode(mode).parquet(x)
    df.select(col(target)).write.mode(mode).parquet(y)
    return x, y
