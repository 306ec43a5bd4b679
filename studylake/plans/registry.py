"""The library's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
FAMILIES = ("mastery", "usage", "catalog", "clean", "layout", "sections", "lessons", "streams")


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function of (spark, folder) under its name, with the SQL that gives the same rows.

    Columns named in dates are given as text on both sides, as clients differ in how they show a date.
    """

    def add(f):
        def shown(spark: SparkSession, folder: str) -> DataFrame:
            return f(spark, folder).withColumns({c: F.col(c).cast("string") for c in dates})

        _QUERIES[f.__name__] = shown if dates else f
        if sql:
            _SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def _load() -> None:
    for name in FAMILIES:
        import_module(f"studylake.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
