"""The driver's tables as the engine's domain inputs: bars, market, cross-sections.

bars: events by user and day. market: the mean close of a day, in place of a benchmark security.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with the place of each row in it (file, row of the file): the order in which one thread of the checking engine reads, whatever tasks read here."""
    return table(spark, sf_dir, name).selectExpr("*", "struct(_metadata.file_path AS file, _metadata.row_index AS row) AS place")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar of each security and session, with the market's bar beside it."""
    b = _own_bars(table(spark, sf_dir, "events"))
    m = b.groupBy("session_date").agg(*_exprs(MARKET_COLUMNS))
    return b.join(m, "session_date").selectExpr("*", *(f"{x} AS {n}" for n, x in DERIVED.items()))


def closes_and_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """security_id, session_date, close (the last known value), vwap, where comparing close and vwap does not hang on how the rows are dealt out.

    Where a bar's close lies so near its mean that the order of the additions decides (the bound is that of two sums of
    doubles in any orders), the values are added one by one in the table's order of rows, as the SQL does on one thread.
    These are few bars; their events alone are read again and sorted."""
    key, e = ["security_id", "session_date"], placed(spark, sf_dir, "events")
    b = _own_bars(e, close="max_by(value, CASE WHEN value IS NOT NULL THEN ts END)")
    near = b.where("trade_count > 2 AND abs(close - vwap) <= 1e-15 * trade_count * greatest(abs(high), abs(low))").select(*key)
    w = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.where("value IS NOT NULL").selectExpr(*_KEY, "place", "value").join(near, key, "left_semi").select(*key, "place", (F.sum("value").over(w) / F.count("value").over(w)).alias("mean"))
    ordered = rows.groupBy(*key).agg(F.max_by("mean", "place").alias("mean"))
    return b.select(*key, "close", "vwap").join(ordered, key, "left").select(*key, "close", F.coalesce("mean", "vwap").alias("vwap"))


def _own_bars(events: DataFrame, **changed: str) -> DataFrame:
    return events.selectExpr(*_KEY, "ts", "value").groupBy("security_id", "session_date").agg(*_exprs(BAR_COLUMNS | changed))


def _exprs(columns: dict[str, str]):
    return [F.expr(x).alias(n) for n, x in columns.items()]


_KEY = ("user_id AS security_id", "CAST(ts AS DATE) AS session_date")
BAR_COLUMNS = {"open": "min_by(value, ts)", "high": "max(value)", "low": "min(value)", "close": "max_by(value, ts)", "volume": "sum(value)", "trade_count": "CAST(count(*) AS DOUBLE)", "vwap": "avg(value)"}
MARKET_COLUMNS = {"market_open": "avg(open)", "market_close": "avg(close)"}
DERIVED = {"typical": "(high + low + close) / 3e0", "dollar": "volume * (high + low + close) / 3e0"}

#: The same as SQL over the view events.
BARS_SQL = """
SELECT *, (high + low + close) / 3e0 AS typical, volume * (high + low + close) / 3e0 AS dollar FROM (
  SELECT b.*, avg(open) OVER (PARTITION BY session_date) AS market_open, avg(close) OVER (PARTITION BY session_date) AS market_close FROM (
    SELECT user_id AS security_id, CAST(ts AS DATE) AS session_date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, ts) AS close, sum(value) AS volume, CAST(count(*) AS DOUBLE) AS trade_count, avg(value) AS vwap
    FROM events GROUP BY ALL) b)
"""
