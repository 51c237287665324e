"""Readers and their gates: periods, contracts, fingerprints, quote windows, dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Periods that each research state may read; any other state is refused."""

    periods: dict[str, tuple[str, str]] = field(default_factory=dict)

    def predicate(self, state: str, on: str) -> Column:
        if state not in self.periods:
            raise PermissionError(f"no period is open in state {state!r}")
        lo, hi = self.periods[state]
        return F.col(on).between(F.to_timestamp(F.lit(lo)), F.to_timestamp(F.lit(hi)))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has the columns; extra columns are tolerated."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: The file that names a table's version folder.
POINTER = "CURRENT"


def current(spark: SparkSession, path: str) -> str:
    """The folder of path's current version; path itself where it has no versions."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return path
    with_ = fs.open(at)
    try:
        return f"{path}/{bytes(with_.readAllBytes()).decode()}"
    finally:
        with_.close()


def lake(spark: SparkSession, path: str, **filters: object) -> DataFrame:
    """A partitioned Parquet lake by union of its schemas; equality filters reach the partitions and the scan."""
    df = spark.read.option("mergeSchema", True).parquet(current(spark, path))
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def gated(df: DataFrame, gate: Gate, state: str, on: str, columns: list[str], also: Column | None = None) -> DataFrame:
    """Columns of the rows of a state's period. The period column is read and dropped again if it is not asked for."""
    require_columns(df, [*columns, on])
    out = df.where(gate.predicate(state, on))
    return (out.where(also) if also is not None else out).select(*columns)


def latest(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The newest version of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contract(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Rows, distinct keys, duplicates, non-finite values and missing times in one aggregate."""
    v = F.col(value).cast("double")
    k = F.count_distinct(F.struct(*keys))
    return df.agg(F.count("*").alias("rows"), k.alias("keys"), (F.count("*") - k).alias("duplicates"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"), F.count_if(F.col(time).isNull()).alias("without_time"))


def fingerprint(df: DataFrame) -> str:
    """An order-free hash of a table's rows: equal tables have equal fingerprints however they are partitioned."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.sha2(F.concat_ws("|", F.count("*"), F.coalesce(F.sum(h), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(*sorted(df.columns), F.lit(7))), F.lit(0))), 256)).first()[0]


def sessions(df: DataFrame, on: str) -> DataFrame:
    """The exchange calendar that the data hold: sessions with their order."""
    d = df.select(F.to_date(on).alias("session_date")).distinct()
    return d.withColumn("session", F.row_number().over(Window.orderBy("session_date")) - 1)


def covered(requests: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (lo, hi) that one complete coverage interval (from_ts, to_ts) holds: all or nothing."""
    on = [requests[k] == coverage[k] for k in keys] + [coverage["from_ts"] <= requests["lo"], coverage["to_ts"] >= requests["hi"]]
    return requests.join(coverage, on, "left_semi")


def quote_window(quotes: DataFrame, requests: DataFrame, coverage: DataFrame, keys: list[str], width: float = 3600.0) -> DataFrame:
    """Quotes of the covered requests only, each once.

    Requests that overlap are merged, so a quote is in one interval at most; intervals meet quotes through buckets of
    width (seconds, or what the times count in), so a key's quotes are not compared with all its requests."""
    from tidemark.operators.joins import bucketed_range

    ok = covered(requests, coverage, keys).select(*keys, "lo", "hi")
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    opens = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    merged = ok.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(order)).groupBy(*keys, "_run").agg(F.min("lo").alias("_from"), F.max("hi").alias("_to")).drop("_run")
    return bucketed_range(merged, quotes, keys, F.col("_from"), F.col("_to"), F.col("quote_ts"), width).select(*quotes.columns)
