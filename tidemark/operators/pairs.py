"""The clock pack's pair plan and tail plan, by rule and by list; orientation is part of a pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each shock leg meets every second leg of four sections.
SHOCK_LEGS = ["resid_tod_tail_1m", "factor_resid_tod_tail_1m", "resid_prevol_norm_1m", "shock_excess_1pct"]
SECOND_LEGS = """
path: body_share_1m, dir_close_extreme_1m, last1_abs_share_3m, last1_abs_share_5m, path_eff_3m, path_eff_5m, same_sign_streak_1m, sign_switch_rate_5m, tail_event_count_5m, tail_event_count_15m
liquidity: range_tod_tail_1m, volume_tod_tail_1m, dollar_volume_tod_tail_1m, trade_count_tod_tail_1m, avg_trade_size_tod_tail_1m, dollar_per_trade_tod_tail_1m, impact_tod_tail_1m, range_per_dollar_1m, effort_result_1m, volume_return_mismatch_1m, trade_intensity_mismatch_1m, prevol_tod_tail_30m, liquidity_rank_20d, idio_share_1m
market: resid_dispersion_tod_tail_1m, tail_breadth_down_1m, tail_breadth_up_1m, tail_breadth_imbalance_1m, market_tod_tail_1m, market_vol_tod_tail_5m, breadth_positive_1m, breadth_change_1m, factor_common_share_1m, resid_cs_rank_1m, resid_rank_velocity_1m, factor_resid_cs_rank_1m
peers: peer_gap_1m, peer_gap_2m, peer_lead_pred_1m, peer_lead_pred_2m, peer_breadth_sign_1m, peer_shock_breadth_1m, peer_dispersion_1m, peer_move_concentration_1m, leader_liquidity_advantage, network_follow_strength
"""
# The other pairs, first leg: second legs, in the plan's order.
OTHER_PAIRS = """
signed_dollar_pressure_1m: resid_tod_tail_1m
signed_volume_pressure_1m: resid_tod_tail_1m
vwap_pressure_1m: resid_tod_tail_1m
wick_skew_pressure_1m: resid_tod_tail_1m
pressure_return_divergence_1m: impact_tod_tail_1m, liquidity_rank_20d
absorption_score_1m: resid_tod_tail_1m, impact_tod_tail_1m, peer_gap_1m
effort_result_1m: clv_signed_1m, vwap_close_location_1m
volume_return_mismatch_1m: dir_close_extreme_1m
trade_intensity_mismatch_1m: dir_close_extreme_1m
upper_rejection_pressure_1m: resid_tod_tail_1m
lower_rejection_pressure_1m: resid_tod_tail_1m
vwap_close_location_1m: dollar_volume_tod_tail_1m
vwap_bar_location_1m: clv_signed_1m
impact_per_dollar_1m: prevol_tod_tail_30m
resid_cs_rank_1m: resid_rank_velocity_1m, resid_rank_accel_1m, resid_dispersion_tod_tail_1m, tail_breadth_imbalance_1m, liquidity_rank_20d
resid_rank_velocity_1m: volume_tod_tail_1m, peer_lead_pred_1m
resid_rank_accel_1m: path_eff_3m
resid_cs_rank_2m: resid_cs_rank_1m
resid_cs_rank_5m: resid_cs_rank_1m
factor_resid_cs_rank_1m: resid_cs_rank_1m, resid_dispersion_tod_tail_1m
tail_breadth_imbalance_1m: market_tod_tail_1m
benchmark_minus_median_1m: breadth_positive_1m
cs_resid_skew_1m: resid_dispersion_tod_tail_1m
cs_resid_kurt_1m: resid_dispersion_tod_tail_1m
market_tod_tail_1m: resid_cs_rank_1m, resid_rank_velocity_1m, lagged_market_response_gap_1m, market_vol_tod_tail_5m, breadth_positive_1m
market_tod_tail_2m: factor_resid_tod_tail_1m
lagged_market_response_gap_1m: liquidity_rank_20d, peer_lead_pred_1m
factor_resid_tod_tail_2m: path_eff_3m
breadth_change_1m: market_tod_tail_1m
benchmark_minus_median_1m: resid_dispersion_tod_tail_1m
peer_lead_pred_1m: peer_breadth_sign_1m, peer_shock_breadth_1m, peer_dispersion_1m, peer_move_concentration_1m, peer_leader_count_1m, leader_liquidity_advantage, network_follow_strength, factor_resid_1m, factor_resid_cs_rank_1m
peer_lead_pred_2m: peer_breadth_sign_1m
peer_gap_1m: peer_breadth_sign_1m, peer_shock_breadth_1m, peer_dispersion_1m, peer_move_concentration_1m, leader_liquidity_advantage, resid_rank_velocity_1m
peer_gap_2m: peer_lead_pred_1m
peer_gap_velocity_1m: peer_breadth_sign_1m, resid_cs_rank_1m
network_follow_strength: liquidity_rank_20d
network_lead_strength: liquidity_rank_20d
dist_session_vwap: volume_tod_tail_1m, resid_tod_tail_1m, vwap_cross_age_signed
dist_session_open: market_tod_tail_1m
dist_prior_close: resid_tod_tail_1m
dist_session_high: volume_tod_tail_1m
dist_session_low: volume_tod_tail_1m
session_range_expansion_tod: resid_tod_tail_1m
same_minute_resid_lag1d: same_minute_resid_mean20d
same_minute_resid_mean5d: resid_cs_rank_1m
same_minute_resid_mean20d: resid_cs_rank_1m, market_tod_tail_1m, prevol_tod_tail_30m
same_minute_rank_mean20d: resid_rank_velocity_1m
squeeze_score_5_30: breakout_dist_high_5m, breakout_dist_low_5m, breakout_dist_high_15m, breakout_dist_low_15m, volume_tod_tail_1m
prevol_ratio_5_30: path_eff_5m
range_ratio_5_30: volume_tod_tail_1m
dollar_volume_ratio_5_30: breakout_dist_high_15m, breakout_dist_low_15m
breakout_dist_high_5m: dir_close_extreme_1m
breakout_dist_low_5m: dir_close_extreme_1m
breakout_dist_high_15m: peer_lead_pred_1m
breakout_dist_low_15m: peer_lead_pred_1m
dist_orh_5m: volume_tod_tail_1m
dist_orl_5m: volume_tod_tail_1m
breakout_age_signed_15m: path_eff_5m
vol_accel_1_5: resid_tod_tail_1m, impact_tod_tail_1m
minutes_since_tail_event: resid_tod_tail_1m
shock_cluster_score_15m: resid_tod_tail_1m, peer_shock_breadth_1m
tail_event_count_15m: resid_dispersion_tod_tail_1m
sign_switch_rate_5m: absorption_score_1m
post_shock_recovery_1m: liquidity_rank_20d, impact_tod_tail_1m
post_shock_recovery_3m: peer_gap_1m
resid_tod_tail_1m: resid_tod_tail_5m, resid_tod_tail_2m
resid_tod_tail_2m: resid_tod_tail_5m
factor_resid_tod_tail_1m: factor_resid_tod_tail_2m
shock_accel_1m: resid_tod_tail_5m
peer_lead_pred_1m: peer_gap_velocity_1m
peer_lead_pred_2m: peer_gap_1m
same_minute_resid_mean20d: peer_lead_pred_1m
same_minute_resid_mean20d: factor_resid_tod_tail_1m
squeeze_score_5_30: peer_lead_pred_1m
squeeze_score_5_30: resid_tod_tail_1m
vwap_cross_age_signed: resid_tod_tail_1m
dist_session_vwap: peer_gap_1m
liquidity_rank_20d: impact_tod_tail_1m
liquidity_rank_20d: dollar_per_trade_tod_tail_1m
"""
# Variables and percentages of the tail surfaces.
TAIL_LEGS = ["resid_tod_tail_1m", "factor_resid_tod_tail_1m", "resid_prevol_norm_1m", "shock_excess_1pct", "peer_gap_1m", "peer_lead_pred_1m"]
TAIL_PERCENTS = [0.1, 0.25, 0.5, 1, 2, 5]
# Bins of a leg of a pair, and of the second leg beside a tail.
RESOLUTIONS, TAIL_RESOLUTIONS = (3, 5, 10), (5, 10)
# Known only after events, hence ranked among the events that a full history holds.
EVENT_LEGS = ["post_shock_recovery_1m", "post_shock_recovery_3m"]


def _lines(text: str) -> list[tuple[str, list[str]]]:
    return [(a.strip(), [x.strip() for x in b.split(",")]) for a, b in (line.split(":") for line in text.strip().splitlines())]


def section(name: str) -> list[str]:
    return dict(_lines(SECOND_LEGS))[name]


def plan() -> list[tuple[str, str]]:
    """Every pair, numbered from 1 by its place."""
    shocks = [(a, b) for a in SHOCK_LEGS for _, legs in _lines(SECOND_LEGS) for b in legs]
    return shocks + [(a, b) for a, legs in _lines(OTHER_PAIRS) for b in legs]


def tails() -> list[tuple[str, float, str]]:
    return [(x, p, side) for x in TAIL_LEGS for p in TAIL_PERCENTS for side in ("lower", "upper")]


def legs() -> list[str]:
    """Every variable of the pair plan and the tail plan."""
    return sorted({x for pair in plan() for x in pair} | set(TAIL_LEGS))


def surfaces() -> list[tuple[str, str, str | None, int, float | None, float | None]]:
    """Every surface: its name, first leg, second leg (none: the tail alone), bins, and the least or most of a tail's rank."""
    out: list[tuple] = [(f"pair_{k}_r{r}", a, b, r, None, None) for k, (a, b) in enumerate(plan(), 1) for r in RESOLUTIONS]
    for x, p, side in tails():
        cut = (None, p / 100) if side == "lower" else (1 - p / 100, None)
        out.append((f"tail_{x}_{p}_{side}", x, None, 1, *cut))
        out += [(f"tail_{k}_{p}_{side}_r{r}", a, b, r, *cut) for k, (a, b) in enumerate(plan(), 1) if a == x for r in TAIL_RESOLUTIONS]
    return out


def scan(ranked: DataFrame, targets: list[str]) -> DataFrame:
    """surface, cell, target, n, mean, sd of every surface of both plans over every target; ranked has q_<leg> in [0, 1] of all legs.

    The surfaces are a table of fixed size, so each row meets them without a shuffle, and all are summed in one."""
    spark, names = ranked.sparkSession, legs()
    at = {x: k for k, x in enumerate(names, 1)}
    rows = [(name, at[a], at[b] if b else None, r, lo, hi) for name, a, b, r, lo, hi in surfaces()]
    tasks = spark.createDataFrame(rows, "surface string, a int, b int, bins int, lo double, hi double")
    wide = ranked.select(F.array(*(F.col(f"q_{x}") for x in names)).alias("ranks"), *targets).where(reduce(lambda a, b: a | b, (F.col(t).isNotNull() for t in targets)))
    long = wide.crossJoin(F.broadcast(tasks)).withColumn("qa", F.element_at("ranks", F.col("a"))).withColumn("qb", F.element_at("ranks", F.coalesce("b", F.lit(1))))
    held = F.col("qa").isNotNull() & (F.col("b").isNull() | F.col("qb").isNotNull()) & F.coalesce(F.col("qa") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("qa") <= F.col("hi"), F.lit(True))
    code = lambda q: F.least(F.floor(F.col(q) * F.col("bins")), F.col("bins") - 1)
    tail = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    cell = F.when(tail, F.lit(0)).otherwise(code("qa") * F.col("bins")) + F.when(F.col("b").isNull(), F.lit(0)).otherwise(code("qb"))
    long = long.where(held).select("surface", cell.cast("int").alias("cell"), *targets)

    def sums(t: str) -> Column:
        return F.struct(F.lit(t).alias("target"), F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("sd"))

    found = long.groupBy("surface", "cell").agg(F.array(*map(sums, targets)).alias("x")).select("surface", "cell", F.explode("x").alias("x"))
    return found.select("surface", "cell", "x.*").where("n > 0")
