"""Rows with a number of their own, for tables whose ids are null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.arrow import plain
from tabprep.sources.storage import stored


def unused(name: str, *frames: DataFrame) -> str:
    """The name, or the name with leading underscores, that no column of the frames has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered_rows(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows and all their columns, with a column of different numbers in ascending order of id and text.

    The number is the id where ids are neither null nor repeated. Otherwise ranges of the order are numbered one by one,
    then shifted, and the table is stored; rows with a null id come first, equal rows stand in an arbitrary order.
    """
    own = plain(key).cast("long")
    if docs.groupBy(own.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.withColumn(name, own)
    order = [own.asc_nulls_first(), plain(text).cast("string").asc_nulls_first()]
    return stored(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
