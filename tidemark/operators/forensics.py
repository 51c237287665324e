"""Distribution, concentration, episodes, admission and path diagnostics."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.columns import sum_before


def islands(df: DataFrame, keys: list[str], order: list[str], joined: Column, out: str = "episode") -> DataFrame:
    """Numbers runs of rows: a row opens a new episode unless `joined` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def distribution(df: DataFrame, y: str, by: Iterable[str] = ()) -> DataFrame:
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    c = F.col(y)
    return df.where(c.isNotNull()).groupBy(*by).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.avg((c > 0).cast("double")).alias("win_rate"), F.avg(F.when(c > 0, c)).alias("average_win"), F.avg(F.when(c < 0, c)).alias("average_loss"),
        *(F.percentile(y, F.lit(x)).alias(f"p{round(100 * x):02d}") for x in q),
    )


def concentration(df: DataFrame, y: str, key: str) -> DataFrame:
    """Share of the signed total in the largest 1 and 5 percent of rows (ceil(n p) rows)."""
    n = df.where(F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.sum(y).alias("total"))
    r = sum_before(df, y, F.lit(1), [key], falling=True).withColumn("r", F.col("before") + 1).crossJoin(F.broadcast(n))
    part = lambda p: F.try_divide(F.sum(F.when(F.col("r") <= F.ceil(F.col("n") * p), F.col(y))), F.first("total"))
    return r.agg(part(0.01).alias("top1"), part(0.05).alias("top5"))


def admitted(df: DataFrame, keys: list[str], order: list[str], hold: int) -> DataFrame:
    """Independent entries: in order, a row is admitted if the last admitted one is at least `hold` positions back. Order-dependent, hence one grouped pass a key."""
    schema = df.schema

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        keep, free = [], None
        for k, at in enumerate(pdf["position"]):
            if free is None or at >= free:
                keep.append(k)
                free = at + hold
        return pdf.iloc[keep]

    return df.groupBy(*keys).applyInPandas(f, schema)


def placebo(df: DataFrame, decision: str, key: list[str], signal: str, y: str, runs: int, seed: int = 0) -> DataFrame:
    """The mean of y over a 0/1 signal (as a share of all rows) against runs in which each decision's signals fall on rows drawn by a seeded hash.

    Columns: effect, p = (1 + runs at least as far from zero) / (runs + 1). One shuffle by decision: each run is a rank of
    its own within the decision, and only sums leave a task."""
    w = Window.partitionBy(decision)
    x = df.select(decision, F.struct(*key).alias("_key"), F.col(signal).cast("double").alias("_s"), F.col(y).alias("_y")).where("_s IS NOT NULL AND _y IS NOT NULL")
    x = x.withColumn("_chosen", F.sum("_s").over(w))
    x = x.withColumns({f"_r{k}": F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.lit(k), "_key"), "_key")) for k in range(runs)})
    sums = x.agg(F.sum(F.col("_s") * F.col("_y")).alias("real"), F.count("*").alias("n"), *(F.sum(F.when(F.col(f"_r{k}") <= F.col("_chosen"), F.col("_y")).otherwise(0.0)).alias(f"m{k}") for k in range(runs)))
    as_far = sum((F.abs(f"m{k}") >= F.abs("real")).cast("int") for k in range(runs))
    return sums.select(((1 + as_far) / F.lit(runs + 1)).alias("p"), F.try_divide("real", "n").alias("effect"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rho: correlation of average ranks. Ranks come from the counts of distinct values, so no window holds all rows."""
    x = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    for c in ("_a", "_b"):
        v = sum_before(x.groupBy(c).agg(F.count("*").alias("_k")), c, F.col("_k"))
        x = x.join(v.select(c, (F.col("before") + (F.col("_k") + 1) / 2).alias(f"_rank{c}")), c)
    return x.agg(F.count("*").alias("n"), F.corr("_rank_a", "_rank_b").alias("rho"))


def crossfit(df: DataFrame, fold: str, a: str, b: str, y: str, bins: int) -> DataFrame:
    """For each fold the cell of largest absolute interaction lift on the other folds (totals less the fold), with both means and lifts; over the cells that both have, the rank correlation, the slope of held-out on training means weighted by held-out rows, and the held-out spread."""
    held = df.groupBy(fold, a, b).agg(F.count("*").alias("hn"), F.sum(y).alias("hs"))
    places = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    every = held.select(fold).distinct().select(fold, places.alias(a)).select(fold, a, places.alias(b))  # folds times cells, however many rows there are
    t = every.join(held, [fold, a, b], "left").fillna(0, ["hn"]).fillna(0.0, ["hs"])
    cell = Window.partitionBy(a, b)
    t = t.withColumn("tn", F.sum("hn").over(cell) - F.col("hn")).withColumn("ts", F.sum("hs").over(cell) - F.col("hs"))

    def lift(n: str, s: str) -> Column:
        part = lambda *by: F.try_divide(F.sum(s).over(Window.partitionBy(fold, *by)), F.sum(n).over(Window.partitionBy(fold, *by)))
        return F.try_divide(s, n) - part(a) - part(b) + part()

    t = t.withColumns({"hm": F.try_divide("hs", "hn"), "tm": F.try_divide("ts", "tn"), "tl": lift("tn", "ts"), "hl": lift("hn", "hs"), "cell": F.col(a) * bins + F.col(b)})
    by = Window.partitionBy(fold)
    rank = lambda c: F.rank().over(by.orderBy(F.round(c, 9))) + (F.count("*").over(Window.partitionBy(fold, F.round(c, 9))) - 1) / 2
    both = t.where("hn > 0 AND tn > 0").withColumn("rt", rank("tm")).withColumn("rh", rank("hm"))
    w = lambda *c: F.sum(F.expr(" * ".join(["hn", *c])))
    agree = both.groupBy(fold).agg(F.corr("rt", "rh").alias("spearman"), F.try_divide(w("tm", "hm") - w("tm") * w("hm") / w(), w("tm", "tm") - w("tm") * w("tm") / w()).alias("slope"), (F.max("hm") - F.min("hm")).alias("heldout_spread"))
    best = t.withColumn("_r", F.row_number().over(by.orderBy(F.round(F.abs("tl"), 9).desc_nulls_last(), "cell"))).where("_r = 1")
    return best.select(fold, "cell", F.col("hn").alias("heldout_n"), F.col("tm").alias("train_mean"), F.col("tl").alias("train_lift"), F.col("hm").alias("heldout_mean"), F.col("hl").alias("heldout_lift")).join(agree, fold)


def concurrency(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Open intervals over time: +1 at a start, -1 at a stop, summed by time before the running sum."""
    ev = df.select(F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(df.select(F.col(stop).alias("t"), F.lit(-1).alias("d")))
    by = ev.groupBy("t").agg(F.sum("d").alias("d")).withColumn("_at", F.unix_micros(F.col("t").cast("timestamp")).cast("double"))
    return sum_before(by, "_at", F.col("d")).select("t", (F.col("before") + F.col("d")).alias("open"))


def capped(signals: DataFrame, slots: int) -> DataFrame:
    """Signals (signal_id, start, stop) admitted while fewer than `slots` are open; ties by id. Inherently global and order-dependent: it takes the reduced signal set in one group."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values(["start", "signal_id"])
        open_: list = []
        took = []
        for start, stop in zip(pdf["start"], pdf["stop"]):
            while open_ and open_[0] <= start:
                heapq.heappop(open_)
            ok = len(open_) < slots
            took.append(ok)
            if ok:
                heapq.heappush(open_, stop)
        return pdf.assign(admitted=took)

    s = signals.select(F.lit(0).alias("all"), "signal_id", "start", "stop")
    schema = "signal_id long, start timestamp, stop timestamp, admitted boolean"
    return s.groupBy("all").applyInPandas(lambda pdf: f(pdf.drop(columns="all")), schema)
