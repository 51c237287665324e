"""Bars, sessions, universe, corporate actions and forward targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(bars: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Buckets of n bars by their ordinal in a session (never across sessions): first, max, min, last, sum, and the volume-weighted price over bars that have one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    b = bars.withColumn("_rn", F.row_number().over(w) - 1).withColumn("bucket", F.floor(F.col("_rn") / n).cast("int"))
    priced = F.col("vwap").isNotNull() & (F.col("volume") > 0)
    return b.groupBy(*keys, "bucket").agg(
        F.min_by("open", "_rn").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "_rn").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("constituent_bars"),
        F.try_divide(F.sum(F.when(priced, F.col("vwap") * F.col("volume"))), F.sum(F.when(priced, F.col("volume")))).alias("vwap"), F.sum("trade_count").alias("trade_count"),
    )


def session_metrics(ticks: DataFrame, keys: list[str], time: str, price: str, volume: str, minutes: tuple[int, ...]) -> DataFrame:
    """Opening and closing returns, ranges and volume shares at clock offsets from a session's first and last tick, in one aggregation."""
    edge = Window.partitionBy(*keys)
    t = F.unix_micros(F.col(time).cast("timestamp")) / 60e6
    x = ticks.withColumn("_t", t).withColumn("_open", F.col("_t") - F.min("_t").over(edge)).withColumn("_close", F.max("_t").over(edge) - F.col("_t"))
    w = Window.partitionBy(*keys).orderBy("_t")
    running = F.try_divide(F.sum(F.col(price) * F.col(volume)).over(w), F.sum(volume).over(w))
    x = x.withColumn("_side", F.signum(F.col(price) - running)).withColumn("_cross", F.when(F.col("_side") * F.lag("_side").over(w) < 0, 1).otherwise(0))
    x = x.withColumn("_v5", F.sum(volume).over(w.rowsBetween(-4, 0)))
    first, last = F.min_by(price, "_t"), F.max_by(price, "_t")
    out = [first.alias("session_open"), last.alias("session_close"), F.max(price).alias("session_high"), F.min(price).alias("session_low"), F.sum(volume).alias("session_volume"), F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("session_vwap"), F.sum("_cross").alias("vwap_cross_count"), F.avg((F.col("_side") > 0).cast("double")).alias("time_above_vwap"), F.try_divide(F.max(volume), F.sum(volume)).alias("largest_1_share"), F.try_divide(F.max("_v5"), F.sum(volume)).alias("largest_5_share")]
    for k in minutes:
        early, late = F.col("_open") <= k, F.col("_close") <= k
        p_open = F.max_by(F.when(early, F.col(price)), F.when(early, F.col("_t")))
        p_late = F.min_by(F.when(late, F.col(price)), F.when(late, F.col("_t")))
        out += [(F.try_divide(p_open, first) - 1).alias(f"opening_return_{k}m"), (F.try_divide(last, p_late) - 1).alias(f"closing_return_{k}m"), F.try_divide(F.max(F.when(early, F.col(price))) - F.min(F.when(early, F.col(price))), first).alias(f"opening_range_pct_{k}m"), F.try_divide(F.sum(F.when(late, F.col(volume))), F.sum(volume)).alias(f"closing_volume_share_{k}m"), F.sum(F.when(early, F.col(volume))).alias(f"opening_volume_{k}m")]
    return x.groupBy(*keys).agg(*out)


def universe(daily: DataFrame, key: str, session: str, close: Column, dollar: Column, least_price: float, least_dollar: float, window: int = 20, least: int = 20) -> DataFrame:
    """Membership known before the session: prior close, and the median dollar volume of the prior sessions."""
    w = Window.partitionBy(key).orderBy(session)
    p = w.rowsBetween(-window, -1)
    x = daily.withColumn("prior_close", F.lag(close).over(w)).withColumn("prior_median", F.percentile(dollar, F.lit(0.5)).over(p)).withColumn("prior_n", F.count(dollar).over(p))
    ok = (F.col("prior_close") >= least_price) & (F.col("prior_median") >= least_dollar) & (F.col("prior_n") >= least)
    return x.withColumn("in_universe", F.coalesce(ok, F.lit(False)))


def split_consistent(bars: DataFrame, factors: DataFrame, keys: list[str], prices: list[str]) -> DataFrame:
    """research_* prices: price over the session's split factor (1 where there is none)."""
    x = bars.join(factors.select(*keys, "split_factor"), keys, "left")
    return x.withColumns({f"research_{p}": F.try_divide(F.col(p), F.coalesce("split_factor", F.lit(1.0))) for p in prices})


def forward_targets(bars: DataFrame, keys: list[str], order: list[str], horizons: tuple[int, ...], open_: str = "open", close: str = "close") -> DataFrame:
    """Entry at the next bar's open, exit at the close of the h-th held bar (the entry bar counts as 1); missing beyond the last bar."""
    w = Window.partitionBy(*keys).orderBy(*order)
    entry = F.lead(open_, 1).over(w)
    return bars.withColumns({f"target_{h}": F.lead(close, h).over(w) / F.nullif(entry, F.lit(0.0)) - 1 for h in horizons})


def fail_closed(targets: DataFrame, actions: DataFrame, key: str, entry: str, exit_: str, target: str) -> DataFrame:
    """A target whose holding period crosses a corporate action (entry < action <= exit) is missing, and flagged.

    A security's actions are few: they come to its targets as one list, so rows stay rows and no pairs are made."""
    a = actions.where("action_date IS NOT NULL").groupBy(F.col(key).alias("_k")).agg(F.collect_set("action_date").alias("_actions"))
    out = targets.join(a, F.col(key) == F.col("_k"), "left")
    crosses = F.exists(F.coalesce("_actions", F.array().cast(a.schema["_actions"].dataType)), lambda d: (d > F.col(entry)) & (d <= F.col(exit_)))
    out = out.withColumn("crosses_action", F.coalesce(crosses, F.lit(False))).drop("_k", "_actions")
    return out.withColumn(target, F.when(~F.col("crosses_action"), F.col(target)))


def beta(df: DataFrame, key: str, session: str, y: str, m: str, window: int, least: int) -> Column:
    """Prior-window covariance over variance on jointly known rows."""
    w = Window.partitionBy(key).orderBy(session).rowsBetween(-window, -1)
    both = F.when(F.col(y).isNotNull() & F.col(m).isNotNull(), 1)
    return F.when(F.count(both).over(w) >= least, F.covar_samp(y, m).over(w) / F.nullif(F.var_samp(F.when(both == 1, F.col(m))).over(w), F.lit(0.0)))


def excursions(paths: DataFrame, by: list[str], step: str, ret: str) -> DataFrame:
    """Best and worst point of each path, the earliest step that reaches it, the end, and what was given back."""
    best, worst = F.max(F.struct(F.col(ret), -F.col(step))), F.min(F.struct(F.col(ret), F.col(step)))
    x = paths.groupBy(*by).agg(best.alias("b"), worst.alias("w"), F.max_by(ret, step).alias("terminal"), F.count("*").alias("steps"))
    return x.select(*by, F.greatest(F.col(f"b.{ret}"), F.lit(0.0)).alias("mfe"), F.least(F.col(f"w.{ret}"), F.lit(0.0)).alias("mae"), (-F.col("b.col2")).alias("time_to_mfe"), F.col(f"w.{step}").alias("time_to_mae"), "terminal", (F.greatest(F.col(f"b.{ret}"), F.lit(0.0)) - F.col("terminal")).alias("giveback"), (F.col("terminal") - F.least(F.col(f"w.{ret}"), F.lit(0.0))).alias("recovery"), "steps")
