"""Functions behind virtual fields, by the resolver's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from nestq.errors import QueryError

Resolver = Callable[[DataFrame], Column]


class Resolvers:
    """``name -> f(DataFrame) -> Column``. Built-in expressions stay in generated code; a pandas_udf is possible."""

    def __init__(self):
        self.known: dict[str, Resolver] = {}

    def register(self, name: str, f: Resolver) -> Resolvers:
        self.known[name] = f
        return self

    def column(self, name: str, df: DataFrame) -> Column:
        if name not in self.known:
            raise QueryError(f"no resolver {name!r} is registered")
        return self.known[name](df)
