"""Base of all fitted steps: parameters, a lazy ``transform``, persistence as JSON and side tables.

A parameter that may be large, such as the categories of a column or the donors of a neighbour search, is a table. In the
parameters stands its mark: ``SIDE_TABLE`` and the path. ``save_fitted`` copies all such tables next to the JSON text, so a
saved step needs nothing outside its own folder.
"""

from __future__ import annotations

import dataclasses
import json
from abc import ABC, abstractmethod
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from tabprep.sources.storage import fresh_path

SIDE_TABLE = "side-table:"


class Fitted(ABC):
    """Learned parameters. ``transform`` only adds Column expressions, so it is lazy and works on
    batch and streaming DataFrames alike."""

    _kinds: ClassVar[dict[str, type[Fitted]]] = {}

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        Fitted._kinds[cls.__name__] = cls

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @property
    def costly(self) -> bool:
        """Whether ``transform`` searches or shuffles. A chain then stores the rows once, as every later fit reads them
        several times, and each time would do it again."""
        return False

    def to_dict(self) -> dict:
        return {"step": type(self).__name__, "params": dataclasses.asdict(self)}

    @staticmethod
    def from_dict(state: dict) -> Fitted:
        kind = Fitted._kinds[state["step"]]
        restore = getattr(kind, "restore", None)
        return restore(state["params"]) if restore else kind(**state["params"])

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @staticmethod
    def from_json(text: str) -> Fitted:
        return Fitted.from_dict(json.loads(text))


def write_side_table(table: DataFrame, label: str) -> str:
    """Store a parameter table in the shared folder; returns its mark."""
    path = fresh_path(table.sparkSession, label)
    table.write.parquet(path)
    return SIDE_TABLE + path


def read_side_table(spark: SparkSession, mark: str) -> DataFrame:
    return spark.read.parquet(mark.removeprefix(SIDE_TABLE))


def _with_marks(state, change):
    """The state with every mark in it replaced by ``change(path)``."""
    if isinstance(state, dict):
        return {k: _with_marks(v, change) for k, v in state.items()}
    if isinstance(state, list):
        return [_with_marks(v, change) for v in state]
    if isinstance(state, str) and state.startswith(SIDE_TABLE):
        return SIDE_TABLE + change(state.removeprefix(SIDE_TABLE))
    return state


def save_fitted(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """Write ``path/params``, one line of JSON text, and ``path/tables/<n>`` through Spark, so any file system works."""
    places: dict[str, str] = {}

    def copied(source: str) -> str:
        if source not in places:
            places[source] = f"tables/{len(places)}"
            spark.read.parquet(source).write.parquet(f"{path}/{places[source]}")
        return places[source]

    state = _with_marks(fitted.to_dict(), copied)
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/params")


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    state = json.loads(spark.read.text(f"{path}/params").first()["value"])
    return Fitted.from_dict(_with_marks(state, lambda place: f"{path}/{place}"))


class Step(ABC):
    """Settings of an operator. ``fit`` runs one or a few aggregations over the whole table."""

    @abstractmethod
    def fit(self, df: DataFrame, target: str | None = None) -> Fitted: ...

    def fit_transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        return self.fit(df, target).transform(df)
