"""Plug-in scorers: models that are loaded once per worker and run on batches; a missing one gives nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScorerRegistry:
    """Names to (loader, return type). A loader returns a function from a pandas Series to a pandas Series."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[[], Callable], str]] = {}

    def register(self, name: str, loader: Callable[[], Callable[[pd.Series], pd.Series]], return_type: str = "double") -> None:
        self._known[name] = (loader, return_type)

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def column(self, name: str, on: Column, return_type: str = "double") -> Column:
        """The scorer's column, or nulls of return_type where none is registered."""
        if name not in self._known:
            return F.lit(None).cast(return_type)
        loader, kind = self._known[name]

        def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fn = loader()
            for s in series:
                yield fn(s)

        return F.pandas_udf(score, kind)(on)

    def apply(self, df: DataFrame, on: str, names: list[str]) -> DataFrame:
        return df.withColumns({n: self.column(n, F.col(on)) for n in names})


def linear_head(vec: Column, weights: list[float], bias: float) -> Column:
    """A linear model on an embedding, as columns."""
    return F.aggregate(F.zip_with(vec.cast("array<double>"), F.array(*map(F.lit, weights)), lambda x, y: x * y), F.lit(float(bias)), lambda s, x: s + x)
