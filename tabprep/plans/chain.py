"""Ordered, named steps with one fit and one lazy transform."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabprep.base import Fitted, Step, load_fitted, save_fitted
from tabprep.operators.schema import align_raw, finalize_output
from tabprep.sources.storage import stored


@dataclass
class FittedChain(Fitted):
    """Fitted steps by name, with the raw schema they expect and the columns they end in."""

    steps: dict = field(default_factory=dict)
    target: str | None = None
    raw_schema: dict = field(default_factory=dict)
    output_columns: list = field(default_factory=list)

    def transform(self, df: DataFrame, steps_to_run: Sequence[str] | None = None) -> DataFrame:
        """Align to the raw columns, run the steps (or some of them), return the final columns with
        the target last. Nothing runs until an action is called on the result."""
        return self.stages(df, steps_to_run)["output"]

    def stages(self, df: DataFrame, steps_to_run: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The lazy table after each step; keeping them is free and serves as a roll-back."""
        chosen = list(self.steps) if steps_to_run is None else list(steps_to_run)
        unknown = [s for s in chosen if s not in self.steps]
        if unknown:
            raise ValueError(f"no step named {unknown[0]!r}")
        expected = T.StructType.fromJson(self.raw_schema)
        if self.target is not None and self.target in df.columns:
            expected = T.StructType([*expected.fields, df.schema[self.target]])
        current = align_raw(df, expected)
        out = {"input": current}
        for name in chosen:
            current = out[name] = self.steps[name].transform(current)
        out["output"] = finalize_output(current, self.output_columns, self.target)
        return out

    def to_dict(self) -> dict:
        return {"step": "FittedChain", "params": {
            "steps": {n: s.to_dict() for n, s in self.steps.items()}, "target": self.target,
            "raw_schema": self.raw_schema, "output_columns": self.output_columns}}

    @classmethod
    def restore(cls, params: dict) -> FittedChain:
        steps = {n: Fitted.from_dict(s) for n, s in params["steps"].items()}
        return cls(**{**params, "steps": steps})

    def save(self, df: DataFrame, path: str) -> None:
        """Write the parameters and the tables that belong to them; see ``base.save_fitted``."""
        save_fitted(self, df.sparkSession, path)

    @staticmethod
    def load(spark, path: str) -> FittedChain:
        return load_fitted(spark, path)


@dataclass
class StepChain(Step):
    """Fit each step on the output of the ones before it. The target stays in the rows but no step
    uses it as a feature.

    A step that is cheap to apply stays lazy: later fits read through it. After one that searches or shuffles (``costly``)
    the rows are stored, unless it is the last; the fitted chain itself never stores anything.
    """

    steps: Sequence[tuple[str, Step]]
    check_rows: bool = True
    after: Callable[[str, DataFrame], DataFrame] | None = None

    def fit(self, df: DataFrame, target: str | None = None) -> FittedChain:
        if self.check_rows and df.isEmpty():
            raise ValueError("there are no rows to fit")
        target_here = target if target in df.columns else None
        current, fitted = df, {}
        for place, (name, step) in enumerate(self.steps, 1):
            fitted[name] = step.fit(current, target_here)
            current = fitted[name].transform(current)
            if fitted[name].costly and place < len(self.steps):
                current = stored(current, "chain")
            if self.check_rows and getattr(step, "handling", "") == "remove" \
                    and current.isEmpty():
                raise ValueError(f"no rows are left after step {name!r}")
            if self.after is not None:
                current = self.after(name, current)
        raw = T.StructType([f for f in df.schema if f.name != target_here])
        return FittedChain(fitted, target_here, raw.jsonValue(),
                           [c for c in current.columns if c != target_here])


def options_from(settings: Mapping[str, Mapping]) -> list[tuple[str, Step]]:
    """Steps from ``{name: {"step": class name, ...settings}}``, in the given order."""
    kinds = {k.__name__: k for k in _all_steps()}
    out = []
    for name, spec in settings.items():
        given = dict(spec)
        out.append((name, kinds[given.pop("step")](**given)))
    return out


def _all_steps() -> list[type[Step]]:
    found, todo = [], [Step]
    while todo:
        kind = todo.pop()
        found.append(kind)
        todo += kind.__subclasses__()
    return found
