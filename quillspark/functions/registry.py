"""Named functions with types from annotations, usable in SQL and on columns."""

from __future__ import annotations

import types
import typing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

TYPES = {str: "string", int: "bigint", float: "double", bool: "boolean", bytes: "binary", list: "array<string>", dict: "map<string,string>"}


def sql_type(annotation: object) -> str:
    """Spark type of an annotation; Optional is unwrapped, anything unknown is a string."""
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        annotation = next((a for a in typing.get_args(annotation) if a is not type(None)), str)
    if typing.get_origin(annotation) is list:
        return f"array<{sql_type(typing.get_args(annotation)[0])}>"
    return TYPES.get(typing.get_origin(annotation) or annotation, "string")


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, dict] = {}

    def tool(self, name: str | None = None, description: str = "", tags: tuple[str, ...] = (), returns: str | None = None) -> Callable:
        """Register a function. One whose arguments are all annotated as pandas Series gets whole Arrow batches, a Series a
        column, and gives a Series of the SQL type `returns`; any other gets values, one call a row."""
        def keep(f: Callable) -> Callable:
            hints = typing.get_type_hints(f)
            given = hints.pop("return", str)
            whole = bool(hints) and all(h is pd.Series for h in hints.values())
            if whole and not returns:
                raise ValueError(f"{name or f.__name__}: a function of Series needs the SQL type it returns")
            self.functions[name or f.__name__] = {
                "f": f, "whole": whole, "returns": returns or sql_type(given), "arguments": {k: "column" if whole else sql_type(v) for k, v in hints.items()},
                "description": description or (f.__doc__ or "").strip(), "tags": tags,
            }
            return f

        return keep

    def _udf(self, name: str):
        t = self.functions[name]
        return F.pandas_udf(t["f"], t["returns"]) if t["whole"] else F.udf(t["f"], t["returns"], useArrow=True)

    def register(self, spark: SparkSession) -> None:
        for name in self.functions:
            spark.udf.register(name, self._udf(name))

    def call(self, name: str, *columns):
        """The function on columns; an unknown name is a KeyError."""
        return self._udf(name)(*columns)

    def schemas(self) -> list[dict]:
        return [{"name": n, **{k: t[k] for k in ("description", "arguments", "returns", "tags")}} for n, t in sorted(self.functions.items())]
