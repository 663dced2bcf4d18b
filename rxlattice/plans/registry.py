"""Registered queries of the claims engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries on import.
_MODULES = ("claims", "knowledge", "cohorts", "evaluation", "monitoring", "storage", "details", "ingest", "master", "extraction", "labelling", "reads")


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under `name`, with the SQL that gives the same rows.

    `dates`: date columns that both sides put out as ISO text, which every engine compares alike.
    """

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = (lambda spark, sf: f(spark, sf).withColumns({d: F.col(d).cast("string") for d in dates})) if dates else f
        if sql is not None:
            _SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        import_module(f"rxlattice.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
