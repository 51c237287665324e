"""Every registered query of the engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: the query's name and the SQL that must give the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(_QUERIES.values()))[0](spark, sf_dir)
