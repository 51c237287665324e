"""Single and pairwise state surfaces: cell moments, summaries, inference, stability."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.columns import normal_two_sided, unpacked


def moments(y: str) -> list[Column]:
    return [F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")]


def dual_cells(df: DataFrame, a: str, b: str, y: str, bins: int, more: Iterable[str] = ()) -> DataFrame:
    """Cell moments of two binned columns; a row with a missing leg or target takes no part. cell = a * bins + b."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()
    return df.where(ok).withColumn("cell", (F.col(a) * bins + F.col(b)).cast("int")).groupBy("cell", *more).agg(*moments(y))


def fused_cells(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Cells of 3, 5 and 10 bins from one shuffle on the packed codes: resolution, cell, n, s, q."""
    base = df.where((F.col(a) < 255) & (F.col(b) < 255) & F.col(y).isNotNull()).groupBy(a, b).agg(*moments(y))
    res = F.explode(F.array(*(F.struct(F.lit(r).alias("resolution"), (unpacked(F.col(a), r) * r + unpacked(F.col(b), r)).cast("int").alias("cell")) for r in (3, 5, 10))))
    return base.select(res.alias("x"), "n", "s", "q").select("x.*", "n", "s", "q").groupBy("resolution", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def lifted(cells: DataFrame, bins: int, by: Iterable[str] = ()) -> DataFrame:
    """Mean, deviation, frequency, standard error and interaction lift (mean - row - column + overall) of each cell."""
    by, a, b = list(by), F.floor(F.col("cell") / bins), F.col("cell") % bins
    c = cells.withColumn("a", a.cast("int")).withColumn("b", b.cast("int"))
    all_, row, col = (Window.partitionBy(*by, *x) for x in ([], ["a"], ["b"]))
    mean = F.col("s") / F.col("n")
    ratio = lambda w: F.sum("s").over(w) / F.sum("n").over(w)
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return (
        c.withColumn("mean", mean)
        .withColumn("sd", F.sqrt(F.when(var < 0, 0.0).otherwise(var)))
        .withColumn("frequency", F.col("n") / F.sum("n").over(all_))
        .withColumn("lift", mean - ratio(row) - ratio(col) + ratio(all_))
        .withColumn("se", F.col("sd") / F.sqrt(F.col("n").cast("double")))
    )


def selected(lift: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """The cell of largest absolute lift, ties to the first cell."""
    w = Window.partitionBy(*by).orderBy(F.abs("lift").desc(), "cell")
    return lift.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def neighbour_support(lift: DataFrame, bins: int) -> DataFrame:
    """For each cell: median absolute lift of same-sign neighbours over its own, and the plateau (1 + neighbours at half its height)."""
    x = lift.select("cell", F.col("a"), F.col("b"), "lift")
    y = lift.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("lift").alias("nl"))
    near = (F.abs(F.col("a") - F.col("na")) + F.abs(F.col("b") - F.col("nb"))) == 1
    same = F.signum("nl") == F.signum("lift")
    out = x.join(y, near, "left").groupBy("cell", "lift").agg(F.percentile(F.when(same, F.abs("nl")), F.lit(0.5)).alias("m"), F.count(F.when(same & (F.abs("nl") >= 0.5 * F.abs("lift")), 1)).alias("k"))
    return out.select("cell", "lift", (F.coalesce("m", F.lit(0.0)) / F.nullif(F.abs("lift"), F.lit(0.0))).alias("retention"), (F.col("k") + 1).alias("plateau"))


def clustered_mean(df: DataFrame, y: str, cluster: str, by: Iterable[str] = ()) -> DataFrame:
    """Mean with a cluster-robust standard error: two levels of sums, G / (G - 1) correction, normal two-sided p."""
    by = list(by)
    c = df.where(F.col(y).isNotNull()).groupBy(*by, cluster).agg(F.count(y).alias("n_c"), F.sum(y).alias("s_c"))
    t = c.groupBy(*by).agg(F.sum("n_c").alias("n"), F.count("*").alias("clusters"), (F.sum("s_c") / F.sum("n_c")).alias("mean"), F.sum(F.col("s_c") * F.col("s_c")).alias("ss"), F.sum(F.col("s_c") * F.col("n_c")).alias("sn"), F.sum(F.col("n_c") * F.col("n_c")).alias("nn"))
    centred = F.col("ss") - 2 * F.col("mean") * F.col("sn") + F.col("mean") * F.col("mean") * F.col("nn")
    g = F.col("clusters").cast("double")
    se = F.when((F.col("n") >= 3) & (g > 1), F.sqrt(F.greatest(centred, F.lit(0.0)) * g / F.nullif(g - 1, F.lit(0.0))) / F.col("n"))
    t = t.withColumn("se", se).withColumn("z", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))
    return t.withColumn("p", normal_two_sided(F.col("z"))).select(*by, "n", "clusters", "mean", "se", "z", "p")


def folds(df: DataFrame, session: str, k: int, out: str = "fold") -> DataFrame:
    """Sessions cut into k runs of near-equal length, in order; the first ones take the remainder."""
    f = df.select(session).distinct().withColumn(out, F.ntile(k).over(Window.orderBy(session)) - 1)
    return df.join(f, session)


def specialist(df: DataFrame, cell: str, symbol: str, y: str, least: int) -> DataFrame:
    """How a cell's effect spreads over symbols: eligible symbols, share positive, dispersion, share of the largest contributions."""
    s = df.where(F.col(y).isNotNull() & F.col(cell).isNotNull()).groupBy(cell, symbol).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    s = s.withColumn("local", F.when(F.col("n") >= least, F.col("s") / F.col("n")))
    s = s.withColumn("r", F.row_number().over(Window.partitionBy(cell).orderBy(F.abs("s").desc(), symbol)))
    total = F.sum(F.abs("s"))
    return s.groupBy(cell).agg(
        F.count("*").alias("symbols"), F.count("local").alias("eligible"), F.avg(F.when(F.col("local").isNotNull(), (F.col("local") > 0).cast("double"))).alias("positive_share"), F.stddev_samp("local").alias("dispersion"),
        (F.sum(F.when(F.col("r") <= 1, F.abs("s")).otherwise(0.0)) / total).alias("top1_share"), (F.sum(F.when(F.col("r") <= 5, F.abs("s")).otherwise(0.0)) / total).alias("top5_share"),
        F.max("local").alias("best_local"), F.min("local").alias("worst_local"), (F.avg(F.abs("local")) / F.nullif(F.abs(F.sum("s") / F.sum("n")), F.lit(0.0))).alias("cancellation"),
    )


def temporal(df: DataFrame, cell: str, fold: str, y: str, expected: int) -> DataFrame:
    """How a cell's effect holds over folds."""
    s = df.where(F.col(y).isNotNull() & F.col(cell).isNotNull()).groupBy(cell, fold).agg(F.count(y).alias("n"), F.avg(y).alias("m"))
    return s.groupBy(cell).agg(
        F.avg((F.col("m") > 0).cast("double")).alias("positive_folds"), F.avg((F.col("m") < 0).cast("double")).alias("negative_folds"), F.min("m").alias("worst"), F.max("m").alias("best"), F.percentile("m", F.lit(0.5)).alias("median"), F.stddev_samp("m").alias("dispersion"),
        F.min("n").alias("least_n"), F.count("*").alias("populated"), F.lit(expected).cast("long").alias("expected"), F.when(F.count("*") < expected, F.lit(0)).otherwise(F.min("n")).cast("long").alias("least_n_all"),
    )
