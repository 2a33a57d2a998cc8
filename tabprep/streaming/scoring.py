"""A fitted step has no state, so it applies to a stream as it does to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabprep.base import Fitted
from tabprep.sources.readers import normalize_missing


def read_stream(spark: SparkSession, path: str, schema: T.StructType,
                files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normalize_missing(reader.parquet(path))


def score_stream(stream: DataFrame, fitted: Fitted) -> DataFrame:
    return fitted.transform(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Append results as parquet; the checkpoint folder makes the sink exactly-once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
