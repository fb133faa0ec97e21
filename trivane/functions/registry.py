"""User functions for BIND: a name bound to a Column function (or to a pandas UDF, the slow path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivane.terms import is_var, var_name


class FunctionRegistry:
    def __init__(self) -> None:
        self._functions: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, function: Callable[..., Column]) -> None:
        """``function`` takes string Columns and returns a string Column."""
        self._functions[name] = function

    def call(self, name: str, *args: str) -> Column:
        if name not in self._functions:
            raise KeyError(f"no function registered as {name!r}")
        columns = [F.col(var_name(a)) if is_var(a) else F.lit(a) for a in args]
        return self._functions[name](*columns)
