"""Staged projections: each stage adds columns from those before it, as DataFrame selects or as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.functions.sqltext import CHECK, SPARK, Sql

Stages = list[dict[str, str]]


def apply(df: DataFrame, stages: Stages) -> DataFrame:
    """Columns of a stage share one projection, so that equal window specifications share one sort."""
    for stage in stages:
        df = df.selectExpr("*", *(f"{x} AS {name}" for name, x in stage.items()))
    return df


def as_sql(source: str, stages: Stages, out: list[str]) -> str:
    ctes = [f"s0 AS ({source})"]
    for k, stage in enumerate(stages):
        cols = ", ".join(f"{x} AS {name}" for name, x in stage.items())
        ctes.append(f"s{k + 1} AS (SELECT *, {cols} FROM s{k})")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(out)} FROM s{len(stages)}"


def outputs(keys: list[str], names: list[str], q: Sql, digits: int = 6) -> list[str]:
    return [*keys, *(f"{q.round(n, digits)} AS {n}" for n in names)]


def run(df: DataFrame, make: Callable[[Sql], Stages], keys: list[str], names: list[str], digits: int = 6, q: Sql = SPARK) -> DataFrame:
    return apply(df, make(q)).selectExpr(*outputs(keys, names, q, digits))


def sql(source: str, make: Callable[[Sql], Stages], keys: list[str], names: list[str], digits: int = 6, q: Sql = CHECK) -> str:
    return as_sql(source, make(q), outputs(keys, names, q, digits))
