"""The queries over the given tables and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.views import BASE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, hold: bool = False):
    """Register a function of Views; sql begins with SELECT or with further common table expressions.

    hold: the query reads interactions, playlists or train more than once, so they are written first.
    """

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir).hold() if hold else Views(spark, sf_dir))
        if sql:
            QUERIES[name].__doc__ = f.__doc__
            SQL[name] = f"WITH {BASE}{' ' if sql.lstrip().upper().startswith('SELECT') else ', '}{sql}"
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    """Rounded to 6 places, as floating sums depend on their order."""
    return F.round(x, 6).alias(name)


def load() -> None:
    """Import the modules that register queries."""
    from weftline.plans import features, matrices, models, ranking, splits  # noqa: F401


load()
