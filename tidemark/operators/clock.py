"""The one-minute pack: features on a completed (session, minute) grid, where a missing minute makes its windows missing.

Windows are strict (every value known). Same-clock history is the prior `hist` sessions of the same security and minute,
all known. The market is the grid's mean. Everything is window expressions; the factor and peer block, which needs a
matrix a session, is in tidemark.operators.factors.
"""

from __future__ import annotations

from tidemark.functions.sqltext import Sql

EPS = "1e-12"
IN = "security_id, session_no"
CLOCK = "security_id, minute"
NOW = "session_no, minute"


class Pack:
    """n30, n20 and n15 are the lengths (minutes, sessions, minutes) that columns are named for; a small table's caller may shorten them."""

    def __init__(self, q: Sql, hist: int, beta_sessions: int, beta_least: int, n30: int = 30, n20: int = 20, n15: int = 15, horizons: tuple[int, ...] | None = None):
        self.q, self.h, self.bs, self.bl = q, hist, beta_sessions, beta_least
        self.n30, self.n20, self.n15, self.horizons = n30, n20, n15, horizons or HORIZONS

    # windows of the session
    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER (PARTITION BY {IN} ORDER BY minute)"

    def lead(self, x: str, k: int) -> str:
        return f"lead({x}, {k}) OVER (PARTITION BY {IN} ORDER BY minute)"

    def strict(self, fn: str, x: str, n: int, lag: int = 0) -> str:
        w = self.q.over(n, lag, IN, "minute")
        return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"

    def so_far(self, fn: str, x: str) -> str:
        """Running aggregate that a missing minute makes unknown for the rest of the session."""
        w = self.q.over(None, 0, IN, "minute")
        return f"CASE WHEN count({x}) {w} = count(*) {w} THEN {fn}({x}) {w} END"

    def clock(self, fn: str, x: str, n: int, lag: int = 1) -> str:
        w = self.q.over(n, lag, CLOCK, "session_no")
        return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"

    def past(self, x: str) -> str:
        w = self.q.over(self.h, 1, CLOCK, "session_no")
        return f"CASE WHEN count({x}) {w} = {self.h} THEN {'collect_list' if self.q.spark else 'list'}({x}) {w} END"

    def tail(self, x: str) -> str:
        q, items = self.q, f"past_{x}"
        return f"CASE WHEN {x} IS NOT NULL AND {items} IS NOT NULL THEN 2e0 * ({q.size(q.only(items, f'x < {x}'))} + 0.5e0 * {q.size(q.only(items, f'x = {x}'))}) / {self.h}e0 - 1e0 END"

    def median(self, items: str) -> str:
        a, b = (self.h + 1) // 2, self.h // 2 + 1
        s = self.q.falling(items)
        return f"({self.q.at(s, str(a))} + {self.q.at(s, str(b))}) / 2e0"

    def robz(self, x: str) -> str:
        return f"({x} - med_{x}) / (1.4826e0 * mad_{x} + {EPS})"

    def stages(self) -> list[dict[str, str]]:
        q, lag, strict, t = self.q, self.lag, self.strict, f"OVER (PARTITION BY {NOW})"
        log1p = lambda x: f"ln(1e0 + {x})"
        s1 = {f"r_{k}": q.div("close", lag("close", k)) + " - 1e0" for k in (1, 2, 3, 5)} | {f"m_{k}": q.div("market", lag("market", k)) + " - 1e0" for k in (1, 2, 3, 5)}
        s1 |= {"c1": lag("close"), "span": "high - low", "dv": "vwap * volume"}
        w = f"OVER (PARTITION BY security_id ORDER BY session_no RANGE BETWEEN {self.bs} PRECEDING AND 1 PRECEDING)"
        both = "CASE WHEN r_1 IS NOT NULL AND m_1 IS NOT NULL THEN {} END"
        mom = lambda x: f"sum({both.format(x)}) {w}"
        s2 = {"bn": f"CAST(count({both.format('1')}) {w} AS DOUBLE)", "b_m": mom("m_1"), "b_r": mom("r_1"), "b_rm": mom("r_1 * m_1"), "b_mm": mom("m_1 * m_1"), "dollar_pool": f"CASE WHEN count(dv) {w} >= {self.bl} THEN {'percentile' if q.spark else 'quantile_cont'}(dv, 0.5) {w} END"}
        s3 = {"beta": f"CASE WHEN bn >= {self.bl} THEN {q.div('b_rm - b_m * b_r / bn', 'b_mm - b_m * b_m / bn')} END"}
        s4 = {f"e_{k}": f"r_{k} - beta * m_{k}" for k in (1, 2, 3, 5)}
        s4 |= {"range_1": q.div("span", "c1"), "lv": log1p("volume"), "ldv": log1p("dv"), "ln_": log1p("trade_count"), "lats": log1p(f"volume / {q.low('trade_count', '1e0')}"), "ldpt": log1p(f"dv / {q.low('trade_count', '1e0')}"), "clv_signed_1m": f"2e0 * (close - low) / (span + {EPS}) - 1e0", "svw": self.so_far("sum", "dv"), "sv": self.so_far("sum", "volume"), "shi": self.so_far("max", "high"), "slo": self.so_far("min", "low"), "sopen": f"first_value(open) OVER (PARTITION BY {IN} ORDER BY minute)"}
        s5 = {"ae": "abs(e_1)", "sg": "CAST(sign(e_1) AS DOUBLE)", "impact_per_dollar_1m": f"abs(e_1) / (dv / 1e6 + {EPS})", "sd30": strict("stddev_samp", "e_1", self.n30, 1), "ss30": f"sqrt({strict('sum', 'e_1 * e_1', self.n30, 1)})", "mv5": f"sqrt({strict('sum', 'm_1 * m_1', 5)})", "resid_dispersion_1m": f"stddev_samp(e_1) {t}", "svwap": q.div("svw", "sv"), "srange": "shi - slo", "v5": f"sqrt({strict('sum', 'e_1 * e_1', 5)})", "v30": f"sqrt({strict('sum', 'e_1 * e_1', self.n30, 5)})"}
        s6 = {"limp": log1p("impact_per_dollar_1m"), "prevol_ratio_5_30": f"v5 / (v30 * sqrt(5e0 / {self.n30}e0) + {EPS})"}
        tod = ["r_1", "e_1", "e_2", "e_3", "e_5", "range_1", "lv", "ldv", "ln_", "lats", "ldpt", "limp", "ss30", "resid_dispersion_1m", "m_1", "m_2", "mv5", "ae", "prevol_ratio_5_30", "srange"]
        s7 = {f"past_{x}": self.past(x) for x in tod}
        rob = ["r_1", "e_1", "lv", "ldv", "ln_", "ae", "prevol_ratio_5_30", "srange"]
        s8 = {f"med_{x}": self.median(f"past_{x}") for x in rob}
        s9 = {f"mad_{x}": self.median(q.each(f"past_{x}", f"abs(x - med_{x})")) for x in rob}
        s9["q99"] = self.upper("past_ae", 0.99)
        z = {x: self.robz(x) for x in rob}
        share = lambda n: q.div("ae", strict("sum", "ae", n))
        eff = lambda n: q.div(f"abs({strict('sum', 'e_1', n)})", strict("sum", "ae", n))
        mid = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (CAST(rank() OVER (PARTITION BY {NOW}, {x} IS NULL ORDER BY {x}) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY {NOW}, {x} IS NULL, {x}) AS DOUBLE) - 1e0) / 2e0 - 0.5e0) / CAST(count({x}) {t} AS DOUBLE) END"
        s10 = {
            "ret_tod_tail_1m": self.tail("r_1"), **{f"resid_tod_tail_{k}m": self.tail(f"e_{k}") for k in (1, 2, 3, 5)}, "ret_tod_robz_1m": z["r_1"], "resid_tod_robz_1m": z["e_1"], "resid_prevol_norm_1m": f"e_1 / (sd30 + {EPS})", "resid_prevol_norm_2m": f"e_2 / (sd30 * sqrt(2e0) + {EPS})", "shock_accel_1m": f"e_1 - {lag('e_1')}", "shock_excess_1pct": f"sg * {q.low('ae - q99', '0e0')} / (q99 + {EPS})",
            "idio_share_1m": f"ae / (ae + abs(beta * m_1) + {EPS})", "body_ret_1m": q.div("close", "open") + " - 1e0", "gap_ret_1m": q.div("open", "c1") + " - 1e0", "body_share_1m": f"abs(close - open) / (span + {EPS})", "dir_close_extreme_1m": "sg * clv_signed_1m", "last1_abs_share_3m": share(3), "last1_abs_share_5m": share(5), "path_eff_3m": eff(3), "path_eff_5m": eff(5), "path_eff_10m": eff(10),
            "switch": f"CASE WHEN sg IS NOT NULL AND {lag('sg')} IS NOT NULL THEN CASE WHEN sg <> {lag('sg')} THEN 1e0 ELSE 0e0 END END", "range_tod_tail_1m": self.tail("range_1"), "volume_tod_tail_1m": self.tail("lv"), "dollar_volume_tod_tail_1m": self.tail("ldv"), "trade_count_tod_tail_1m": self.tail("ln_"), "avg_trade_size_tod_tail_1m": self.tail("lats"), "dollar_per_trade_tod_tail_1m": self.tail("ldpt"), "impact_tod_tail_1m": self.tail("limp"),
            "range_per_dollar_1m": f"range_1 / (dv / 1e6 + {EPS})", "effort_result_1m": f"{z['ldv']} - {z['ae']}", "volume_return_mismatch_1m": f"{z['lv']} - {z['ae']}", "trade_intensity_mismatch_1m": f"{z['ln_']} - {z['ae']}", "prevol_tod_tail_30m": self.tail("ss30"), "liquidity_rank_20d": mid("dollar_pool"), "z_dv": z["ldv"], "z_v": z["lv"], "vwap_close_location_1m": f"(close - vwap) / (span + {EPS})", "vwap_bar_location_1m": f"(vwap - low) / (span + {EPS})",
            **{f"resid_cs_rank_{k}m": mid(f"e_{k}") for k in (1, 2, 5)}, "resid_dispersion_tod_tail_1m": self.tail("resid_dispersion_1m"), "xn": f"CAST(count(e_1) {t} AS DOUBLE)", "xm": f"avg(e_1) {t}", "median_stock_ret_1m": f"{'percentile' if q.spark else 'quantile_cont'}(r_1, 0.5) {t}", "market_tod_tail_1m": self.tail("m_1"), "market_tod_tail_2m": self.tail("m_2"), "market_vol_tod_tail_5m": self.tail("mv5"), "lagged_market_response_gap_1m": f"beta * {lag('m_1')} - r_1", "breadth_positive_1m": f"avg(CASE WHEN r_1 IS NOT NULL THEN CASE WHEN r_1 > 0 THEN 1e0 ELSE 0e0 END END) {t}",
            "dist_session_vwap": q.div("close", "svwap") + " - 1e0", "dist_session_open": q.div("close", "sopen") + " - 1e0", "dist_prior_close": q.div("close", "prior_session_close") + " - 1e0", "dist_session_high": q.div("close", "shi") + " - 1e0", "dist_session_low": q.div("close", "slo") + " - 1e0", "session_range_expansion_tod": q.div("srange", "med_srange") + " - 1e0", "same_minute_resid_lag1d": f"lag(e_1) OVER (PARTITION BY {CLOCK} ORDER BY session_no)", "same_minute_resid_mean5d": self.clock("avg", "e_1", 5), "same_minute_resid_mean20d": self.clock("avg", "e_1", self.n20),
            "range_ratio_5_30": q.div(strict("sum", "range_1", 5), f"({strict('sum', 'range_1', self.n30, 5)}) * 5e0 / {self.n30}e0"), "dollar_volume_ratio_5_30": q.div(strict("sum", "dv", 5), f"({strict('sum', 'dv', self.n30, 5)}) * 5e0 / {self.n30}e0"), "squeeze_score_5_30": f"-({z['prevol_ratio_5_30']})", **{f"breakout_dist_{side}_{n}m": q.div("close", strict(fn, "close", n, 1)) + " - 1e0" for side, fn in (("high", "max"), ("low", "min")) for n in (5, self.n15)},
            "orh": f"CASE WHEN minute >= 4 THEN max(CASE WHEN minute < 5 THEN high END) {q.over(None, 0, IN, 'minute')} END", "orl": f"CASE WHEN minute >= 4 THEN min(CASE WHEN minute < 5 THEN low END) {q.over(None, 0, IN, 'minute')} END", "side": "CAST(sign(close - svwap) AS DOUBLE)", "vol_accel_1_5": f"ae / (v5 / sqrt(5e0) + {EPS})", "ph": strict("max", "high", self.n15, 1), "pl": strict("min", "low", self.n15, 1),
        }
        shock = lambda f: f"CASE WHEN resid_tod_tail_1m IS NOT NULL THEN CASE WHEN abs(resid_tod_tail_1m) >= {f} THEN 1e0 ELSE 0e0 END END"
        run = self.q.over(None, 0, IN, "minute")
        s11 = {
            "tail98": shock("0.98e0"), "tail96": shock("0.96e0"), "sign_switch_rate_5m": strict("avg", "switch", 5), "streak_from": f"max(CASE WHEN switch IS NULL OR switch = 1e0 THEN minute END) {run}", "signed_dollar_pressure_1m": "clv_signed_1m * z_dv", "signed_volume_pressure_1m": "clv_signed_1m * z_v", "vwap_pressure_1m": "vwap_close_location_1m * z_dv", "upper_rejection_pressure_1m": f"(high - greatest(open, close)) / (span + {EPS}) * {q.low('z_dv', '0e0')}", "lower_rejection_pressure_1m": f"(least(open, close) - low) / (span + {EPS}) * {q.low('z_dv', '0e0')}",
            "wick_skew_pressure_1m": f"((least(open, close) - low) - (high - greatest(open, close))) / (span + {EPS}) * {q.low('z_dv', '0e0')}", "absorption_score_1m": f"clv_signed_1m * {q.low('z_dv - abs(resid_tod_robz_1m)', '0e0')}", "resid_rank_velocity_1m": f"resid_cs_rank_1m - {lag('resid_cs_rank_1m')}", **{f"tail_breadth_{n}_1m": f"avg(CASE WHEN resid_tod_tail_1m IS NOT NULL THEN CASE WHEN resid_tod_tail_1m {c} THEN 1e0 ELSE 0e0 END END) {t}" for n, c in (("down", "<= -0.98e0"), ("up", ">= 0.98e0"))},
            **{f"k{p}": f"avg(pow(e_1 - xm, {p}e0)) {t}" for p in (2, 3, 4)}, "benchmark_minus_median_1m": "m_1 - median_stock_ret_1m", "breadth_change_1m": f"breadth_positive_1m - {lag('breadth_positive_1m')}", "same_minute_rank_mean20d": self.clock("avg", "resid_cs_rank_1m", self.n20), "dist_orh_5m": q.div("close", "orh") + " - 1e0", "dist_orl_5m": q.div("close", "orl") + " - 1e0",
            "turn": f"CASE WHEN side IS NOT NULL AND side = {lag('side')} THEN 0 ELSE 1 END", "broke": "CASE WHEN high > ph THEN 1e0 WHEN low < pl THEN -1e0 END", "unknown": "CASE WHEN resid_tod_tail_1m IS NULL THEN minute END", "prior_sign": f"sign({lag('resid_tod_tail_1m')})",
        }
        before = self.q.over(None, 0, IN, "minute").replace("CURRENT ROW", "1 PRECEDING")
        decay = " + ".join(f"exp(-{k}e0 / 5e0) * {lag('tail96', k)}" for k in range(1, self.n15 + 1))
        s12 = {
            "same_sign_streak_1m": "sg * (minute - streak_from + 1)", "tail_event_count_5m": strict("sum", "tail98", 5), "tail_event_count_15m": strict("sum", "tail98", self.n15), "pressure_return_divergence_1m": "signed_dollar_pressure_1m - resid_tod_robz_1m", "resid_rank_accel_1m": f"resid_rank_velocity_1m - {lag('resid_rank_velocity_1m')}", "tail_breadth_imbalance_1m": "tail_breadth_up_1m - tail_breadth_down_1m",
            "cs_resid_skew_1m": f"CASE WHEN xn > 2 THEN sqrt(xn * (xn - 1e0)) / (xn - 2e0) * {q.div('k3', 'pow(k2, 1.5e0)')} END", "cs_resid_kurt_1m": f"CASE WHEN xn > 3 THEN (xn - 1e0) / ((xn - 2e0) * (xn - 3e0)) * ((xn + 1e0) * {q.div('k4', 'k2 * k2')} - 3e0 * (xn - 1e0)) END", "vwap_cross_age_signed": f"side * (minute - max(CASE WHEN turn = 1 THEN minute END) {run})", "broke_at": f"max(CASE WHEN broke IS NOT NULL THEN minute END) {run}", "tail_at": f"max(CASE WHEN tail98 = 1e0 THEN minute END) {before}", "unknown_at": f"max(unknown) {before}",
            "post_shock_recovery_1m": f"CASE WHEN {lag('tail96')} = 1e0 THEN -prior_sign * r_1 END", "shock_cluster_score_15m": decay, "shock_at": f"max(CASE WHEN tail96 = 1e0 THEN minute END) {before}",
        }
        s13 = {
            "breakout_age_signed_15m": f"({self.last_known('broke')}) * (minute - broke_at)",
            "minutes_since_tail_event": "CASE WHEN unknown_at IS NOT NULL AND (tail_at IS NULL OR unknown_at > tail_at) THEN NULL WHEN tail_at IS NULL THEN 30 ELSE least(30, minute - tail_at) END",
            "post_shock_recovery_3m": "CASE WHEN minute - shock_at <= 3 THEN " + f"-CASE minute - shock_at WHEN 1 THEN sign({lag('resid_tod_tail_1m', 1)}) * r_1 WHEN 2 THEN sign({lag('resid_tod_tail_1m', 2)}) * r_2 WHEN 3 THEN sign({lag('resid_tod_tail_1m', 3)}) * r_3 END END",
        }
        s14 = {f"fwd_raw_{h}m": q.div(self.lead("close", h), "close") + " - 1e0" for h in self.horizons} | {f"fwd_market_{h}": q.div(self.lead("market", h), "market") + " - 1e0" for h in self.horizons} | {f"step_raw_p{h}": q.div(self.lead("close", h), self.lead("close", h - 1) if h > 1 else "close") + " - 1e0" for h in range(1, 6)}
        s15 = {f"fwd_beta_resid_{h}m": f"fwd_raw_{h}m - beta * fwd_market_{h}" for h in self.horizons}
        return [s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12, s13, s14, s15]

    def target_stages(self) -> list[dict[str, str]]:
        """The stages that the targets need."""
        s1, s2, s3, *_, s14, s15 = self.stages()
        return [s1, s2, s3, s14, s15]

    def liquidity_stages(self) -> list[dict[str, str]]:
        """The stages that the liquidity rank needs; they give r_1 and r_2 too."""
        made = self.stages()
        return [*made[:2], {"liquidity_rank_20d": made[9]["liquidity_rank_20d"]}]

    def last_known(self, x: str) -> str:
        w = self.q.over(None, 0, IN, "minute")
        return f"last_value({x}, true) {w}" if self.q.spark else f"last_value({x} IGNORE NULLS) {w}"

    def upper(self, items: str, p: float) -> str:
        """Linear quantile of a full list."""
        at = p * (self.h - 1)
        k, f = int(at), at - int(at)
        s, q = self.q.falling(items), self.q
        lo, hi = q.at(s, str(self.h - k)), q.at(s, str(max(self.h - k - 1, 1)))
        return f"{lo} + CAST({f!r} AS DOUBLE) * ({hi} - {lo})"


#: Forward horizons, in minutes.
HORIZONS = (1, 2, 3, 5, 10, 15, 30)
BLOCKS = {
    "shock": ["ret_tod_tail_1m", "resid_tod_tail_1m", "resid_tod_tail_2m", "resid_tod_tail_3m", "resid_tod_tail_5m", "ret_tod_robz_1m", "resid_tod_robz_1m", "resid_prevol_norm_1m", "resid_prevol_norm_2m", "shock_accel_1m", "shock_excess_1pct", "idio_share_1m", "body_ret_1m", "gap_ret_1m", "body_share_1m", "clv_signed_1m", "dir_close_extreme_1m", "last1_abs_share_3m", "last1_abs_share_5m", "path_eff_3m", "path_eff_5m", "path_eff_10m", "same_sign_streak_1m", "sign_switch_rate_5m", "tail_event_count_5m", "tail_event_count_15m"],
    "liquidity": ["range_tod_tail_1m", "volume_tod_tail_1m", "dollar_volume_tod_tail_1m", "trade_count_tod_tail_1m", "avg_trade_size_tod_tail_1m", "dollar_per_trade_tod_tail_1m", "impact_per_dollar_1m", "impact_tod_tail_1m", "range_per_dollar_1m", "effort_result_1m", "volume_return_mismatch_1m", "trade_intensity_mismatch_1m", "prevol_tod_tail_30m", "liquidity_rank_20d", "signed_dollar_pressure_1m", "signed_volume_pressure_1m", "vwap_close_location_1m", "vwap_bar_location_1m", "vwap_pressure_1m", "upper_rejection_pressure_1m", "lower_rejection_pressure_1m", "wick_skew_pressure_1m", "pressure_return_divergence_1m", "absorption_score_1m"],
    "market": ["resid_cs_rank_1m", "resid_cs_rank_2m", "resid_cs_rank_5m", "resid_rank_velocity_1m", "resid_rank_accel_1m", "resid_dispersion_1m", "resid_dispersion_tod_tail_1m", "tail_breadth_down_1m", "tail_breadth_up_1m", "tail_breadth_imbalance_1m", "cs_resid_skew_1m", "cs_resid_kurt_1m", "median_stock_ret_1m", "benchmark_minus_median_1m", "market_tod_tail_1m", "market_tod_tail_2m", "market_vol_tod_tail_5m", "lagged_market_response_gap_1m", "breadth_positive_1m", "breadth_change_1m"],
    "session": ["dist_session_vwap", "dist_session_open", "dist_prior_close", "dist_session_high", "dist_session_low", "session_range_expansion_tod", "same_minute_resid_lag1d", "same_minute_resid_mean5d", "same_minute_resid_mean20d", "same_minute_rank_mean20d", "prevol_ratio_5_30", "range_ratio_5_30", "dollar_volume_ratio_5_30", "squeeze_score_5_30", "breakout_dist_high_5m", "breakout_dist_low_5m", "breakout_dist_high_15m", "breakout_dist_low_15m", "dist_orh_5m", "dist_orl_5m", "vwap_cross_age_signed", "breakout_age_signed_15m", "minutes_since_tail_event", "post_shock_recovery_1m", "post_shock_recovery_3m", "shock_cluster_score_15m", "vol_accel_1_5"],
    "targets": [f"fwd_raw_{h}m" for h in HORIZONS] + [f"fwd_beta_resid_{h}m" for h in HORIZONS] + [f"step_raw_p{h}" for h in range(1, 6)],
}
#: The targets that need the session's factor model, and the pack's columns that are projected for them.
FACTOR_TARGETS = {f"fwd_factor_resid_{h}m": f"fwd_raw_{h}m" for h in HORIZONS} | {f"step_factor_resid_p{h}": f"step_raw_p{h}" for h in range(1, 6)}
