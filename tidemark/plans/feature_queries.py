"""Feature queries over the bars of the events table, one a family."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import register
from tidemark.functions.sqltext import CHECK, SPARK
from tidemark.operators import features
from tidemark.plans import staged
from tidemark.sources import tables

KEYS = ["security_id", "session_date"]
DIGITS = 6


def family(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = tables.bars(spark, sf_dir)
    if name == "calendar":
        df = df.selectExpr("*", "570e0 + pmod(security_id, 390) AS minute")
    return staged.run(df, partial(_stages, name), KEYS, features.concepts(name), DIGITS, SPARK)


def _stages(name: str, q) -> list[dict[str, str]]:
    return features.stages(name, q)


def _sql(name: str) -> str:
    source = tables.BARS_SQL
    if name == "calendar":
        source = f"SELECT *, 570e0 + security_id % 390 AS minute FROM ({source})"
    return staged.sql(source, partial(_stages, name), KEYS, features.concepts(name), DIGITS, CHECK)


for _name in features.FAMILIES:
    register(f"features_{_name}", _sql(_name))(partial(family, name=_name))


#: Fast and slow sessions of the approved pairs that tables of a month can hold.
PAIRS = [(6, 1, 5), (6, 2, 10), (6, 5, 20)]
#: Windows in sessions at which these families run beside the six of the queries above.
WINDOWS = {"returns": [(2, 3, 10), (5, 3, 10), (10, 3, 10)], "consistency": [(5, 3, 10), (10, 3, 10)], "volatility": [(5, 2, 10), (10, 5, 20)], "volume": [(5, 3, 10), (10, 3, 10)]}


def scaled(spark: SparkSession, sf_dir: str, name: str, scales: list[tuple[int, int, int]]) -> DataFrame:
    made, names = features.at_scales(name, SPARK, scales)
    return staged.apply(tables.bars(spark, sf_dir), made).selectExpr(*staged.outputs(KEYS, names, SPARK, DIGITS))


def _scaled_sql(name: str, scales: list[tuple[int, int, int]]) -> str:
    made, names = features.at_scales(name, CHECK, scales)
    return staged.as_sql(tables.BARS_SQL, made, staged.outputs(KEYS, names, CHECK, DIGITS))


for _name, _scales in {"multispeed": PAIRS, **WINDOWS}.items():
    register(f"scales_{_name}", _scaled_sql(_name, _scales))(partial(scaled, name=_name, scales=_scales))
