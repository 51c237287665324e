"""As-of, range and offset joins as DataFrame compositions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], *, strict: bool = False, forward: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the values of right's last row at or before it (first at or after it when forward; strict excludes equality).

    One union and one window per key: no candidate pairs are made, so it costs a sort whatever the densities are. Where a
    key may be hot, bucket (a function of the time that never falls, such as its day) splits its rows over tasks; what the
    buckets before leave behind comes by a window over one row a bucket.
    """
    on = F.col(left_on).cast(right.schema[right_on].dataType) if right_on in right.columns else F.col(left_on)
    took = F.struct(*(F.col(v) for v in values))
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), on.alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(took).schema[0].dataType).alias("_right"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), took.alias("_right"))
    # rows of one time: right first, so that left sees it; left first when equality is excluded. Forward reverses both.
    side = F.col("_side") if not strict else 1 - F.col("_side")
    order = [F.col("_t").desc(), side] if forward else [F.col("_t"), side]
    by = [f"_k{i}" for i in range(len(keys))]
    rows = a.unionByName(b)
    if bucket is not None:
        rows = rows.withColumn("_bucket", bucket(F.col("_t")))
        edge = (F.min_by if forward else F.max_by)("_right", F.when(F.col("_side") == 0, F.col("_t")))
        left_behind = Window.partitionBy(*by).orderBy(F.col("_bucket").desc() if forward else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        carried = rows.groupBy(*by, "_bucket").agg(edge.alias("_edge")).withColumn("_carried", F.last("_edge", ignorenulls=True).over(left_behind)).drop("_edge")
    w = Window.partitionBy(*by, *(["_bucket"] if bucket is not None else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if bucket is not None:
        same = reduce(lambda x, y: x & y, (out[c].eqNullSafe(carried[c]) for c in [*by, "_bucket"]))
        out = out.join(carried, same, "left").withColumn("_hit", F.coalesce("_hit", "_carried"))
    return out.select("_left.*", *(F.col(f"_hit.{v}").alias(v) for v in values))


def bucketed_range(left: DataFrame, right: DataFrame, keys: list[str], lo: Column, hi: Column, at: Column, width: float) -> DataFrame:
    """Pairs with equal keys and lo <= at < hi (at of right). Each left row is laid into the buckets of its interval, so that the join is an equi-join."""
    a = left.withColumn("_lo", lo.cast("double")).withColumn("_hi", hi.cast("double"))
    a = a.where("_hi > _lo").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    b = right.withColumn("_at", at.cast("double")).withColumn("_bucket", F.floor(F.col("_at") / width))
    return a.join(b, [*keys, "_bucket"]).where("_at >= _lo AND _at < _hi").drop("_lo", "_hi", "_at", "_bucket")


def pairs_of(ids: DataFrame, name: str) -> DataFrame:
    """All unordered pairs of a small catalogue of ids (a < b)."""
    return ids.select(F.col(name).alias("a")).join(ids.select(F.col(name).alias("b")), F.col("a") < F.col("b"))
