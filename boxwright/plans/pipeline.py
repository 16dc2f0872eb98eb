"""Pipelines of registered operators, saved as JSON and run as one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, ios
from .registry import Param, Registry

OPERATORS = Registry("operators")


class Operator:
    """A step: columns that it reads, columns that it adds, parameters, and a DataFrame to DataFrame function."""

    used: tuple[str, ...] = ()
    added: tuple[str, ...] = ()

    def __init__(self, **values):
        self.params = self.parameters()
        for name, value in values.items():
            if name not in self.params:
                raise KeyError(f"{type(self).__name__} has no parameter {name}")
            self.params[name].set(value)

    def parameters(self) -> dict[str, Param]:
        return {}

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.used if c not in df.columns]:
            raise ValueError(f"{type(self).__name__} needs columns {', '.join(missing)}")
        out = self.apply(df)
        if missing := [c for c in self.added if c not in out.columns]:
            raise ValueError(f"{type(self).__name__} did not add {', '.join(missing)}")
        return out


@OPERATORS.register()
class IosOperator(Operator):
    """Adds ios of boxes a_x1.. and b_x1.., of the first or, if double is set, of both as an array."""

    used = tuple(f"{p}{c}" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2"))
    added = ("ios",)

    def parameters(self) -> dict[str, Param]:
        return {"double": Param(bool, False)}

    def apply(self, df: DataFrame) -> DataFrame:
        a, b = box("a_"), box("b_")
        return df.withColumn("ios", F.array(ios(a, b), ios(b, a)) if self.params["double"].get() else ios(a, b))


@OPERATORS.register()
class FilterOperator(Operator):
    """Keeps rows whose column is over a threshold."""

    def parameters(self) -> dict[str, Param]:
        return {"column": Param(str, "ios"), "threshold": Param(float, 0.0)}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.params["column"].get()) > self.params["threshold"].get())


class Pipeline:
    """Operators by alias, run in the order given."""

    def __init__(self, tasks: dict[str, str], operators: dict[str, dict] | None = None):
        self.tasks, self.settings = tasks, operators or {}
        self.steps: list[tuple[str, Operator]] = [(alias, OPERATORS[name](**self.settings.get(alias, {}))) for alias, name in tasks.items()]

    @classmethod
    def from_json(cls, path: str) -> Pipeline:
        body = json.loads(Path(path).read_text())
        return cls(body["tasks"], body.get("operators"))

    def to_json(self, path: str) -> None:
        values = {alias: {n: p.get() for n, p in step.params.items()} for alias, step in self.steps}
        Path(path).write_text(json.dumps({"tasks": self.tasks, "operators": values}, indent=4, ensure_ascii=False))

    def run(self, df: DataFrame, callbacks: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        for callback in callbacks or []:
            df = df.transform(callback)
        return df


#: Result codes of failed steps by kind of error.
ERROR_CODES = {"FileNotFoundError": 10, "KeyError": 20, "TypeError": 30, "ValueError": 40, "IndexError": 15, "ZeroDivisionError": 16}


def guarded(step: Callable[..., DataFrame]) -> Callable[..., tuple[DataFrame | None, int, str]]:
    """A step that gives (result, code, message) instead of raising; 0 is success and 99 any other error."""

    def run(*args, **kwargs):
        try:
            return step(*args, **kwargs), 0, ""
        except Exception as e:  # the kind of error is the result
            return None, ERROR_CODES.get(type(e).__name__, 99), str(e)

    return run
