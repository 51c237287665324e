"""Regressors on MLlib: imputation, fit, out-of-fold judgement, and a formula compiler."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regressors() -> dict[str, Callable]:
    """Ridge, elastic net, boosted trees, forest. Extremely randomised trees and small neural regressors have no MLlib twin."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    common = {"featuresCol": "features", "labelCol": "y"}
    return {
        "ridge": lambda: LinearRegression(regParam=10.0, elasticNetParam=0.0, **common), "elastic_net": lambda: LinearRegression(regParam=0.001, elasticNetParam=0.1, **common),
        "boosted": lambda: GBTRegressor(maxDepth=3, maxIter=100, seed=7, **common), "forest": lambda: RandomForestRegressor(maxDepth=8, numTrees=100, seed=7, **common),
    }


def out_of_fold(df: DataFrame, features: list[str], y: str, fold: str, kind: str = "ridge") -> DataFrame:
    """Each fold predicted by a model of the others: rows, squared error and correlation by fold."""
    from pyspark.ml.feature import VectorAssembler

    df = df.withColumn("y", F.col(y))
    out = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        means = train.agg(*(F.avg(c).alias(c) for c in features)).first()
        pack = VectorAssembler(inputCols=features, outputCol="features")
        ready = lambda d: pack.transform(d.fillna({c: means[c] or 0.0 for c in features}))  # noqa: B023, E731
        p = regressors()[kind]().fit(ready(train)).transform(ready(test))
        out.append(p.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("mse"), F.corr("prediction", "y").alias("corr")))
    return reduce(DataFrame.unionByName, out)


def ewma(x: Column, span: int, past: Window) -> Column:
    """Exponential average of the known values so far, a = 2 / (span + 1), over a window beyond which nothing weighs in a double."""
    import math

    a = 2 / (span + 1)
    rows = math.ceil(37 / -math.log(1 - a)) if a < 1 else 1
    items = F.collect_list(x).over(past.rowsBetween(-rows, 0))
    return F.aggregate(items, F.lit(None).cast("double"), lambda s, v: F.when(s.isNull(), v).otherwise((1 - a) * s + a * v))


def compile_formula(node: dict, decision: str, key: str, order: str, depth: int = 0) -> Column:
    """A formula {"op", "args"} or {"feature"} as a column: sign, abs, rank, zscore (population deviation); min, max, add, subtract, multiply; delay, delta, ewma."""
    if depth > 3:
        raise ValueError("formulas are at most three levels deep")
    if "feature" in node:
        return F.col(node["feature"])
    op, args = node["op"], [compile_formula(a, decision, key, order, depth + 1) if isinstance(a, dict) else a for a in node["args"]]
    by, past = Window.partitionBy(decision), Window.partitionBy(key).orderBy(order)
    from tidemark.operators.columns import average_rank

    unary = {"sign": lambda x: F.signum(x), "abs": lambda x: F.abs(x), "rank": lambda x: average_rank(x, [decision]), "zscore": lambda x: (x - F.avg(x).over(by)) / F.nullif(F.stddev_pop(x).over(by), F.lit(0.0))}
    binary = {"min": F.least, "max": F.greatest, "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}
    timed = {"delay": lambda x, k: F.lag(x, k).over(past), "delta": lambda x, k: x - F.lag(x, k).over(past), "ewma": lambda x, span: ewma(x, span, past)}
    return {**unary, **binary, **timed}[op](*args)
