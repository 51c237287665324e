"""The feature catalogue: every concept of a family as a formula over bars, window n with fast and slow companions.

Missing is NULL and nothing else; a division by zero is NULL. Windows are over rows of a security in session order and
need min(n, max(5, ceil(0.6 n))) observations unless a formula says otherwise.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from tidemark.functions.sqltext import Sql, required

EPS = "1e-12"


def returns_base(q: Sql) -> dict[str, str]:
    """Bar returns of the security and the market, signs, and their parts."""
    return {
        "prior_close": q.lag("close"),
        "prior_market": q.lag("market_close"),
        "prior_high": q.lag("high"),
        "prior_low": q.lag("low"),
        "rn": f"CAST(row_number() OVER (PARTITION BY {q.key} ORDER BY {q.order}) AS DOUBLE)",
        "lp": q.ln("close"),
    }


def returns_more(q: Sql) -> dict[str, str]:
    return {
        "r": q.div("close", "prior_close") + " - 1e0",
        "m": q.div("market_close", "prior_market") + " - 1e0",
        "overnight": q.div("open", "prior_close") + " - 1e0",
        "regular": q.div("close", "open") + " - 1e0",
        "market_gap_": q.div("market_open", "prior_market") + " - 1e0",
        "tr": "greatest(high - low, abs(high - prior_close), abs(low - prior_close))",
        "dlp": f"lp - {q.lag('lp')}",
        "lv": q.ln("1e0 + volume"),
    }


def returns_parts(q: Sql) -> dict[str, str]:
    return {
        "up": "CASE WHEN r IS NOT NULL THEN greatest(r, 0e0) END",
        "down": "CASE WHEN r IS NOT NULL THEN least(r, 0e0) END",
        "sgn": "CAST(sign(r) AS DOUBLE)",
        "ar": "abs(r)",
        "r1": q.lag("r"),
        "m1": q.lag("m"),
        "dv": f"lv - {q.lag('lv')}",
        "dtyp": f"typical - {q.lag('typical')}",
        "dp": f"close - {q.lag('close')}",
        "trp": q.div("tr", "prior_close"),
    }


BASE = [returns_base, returns_more, returns_parts]


def simple(q: Sql, n: int, p: str = "close") -> str:
    return q.div(p, q.lag(p, n)) + " - 1e0"


def slope(q: Sql, y: str, n: int, lag: int = 0) -> str:
    """Least-squares slope of y on places scaled to [-1, 1]."""
    return f"({q.pair('regr_slope', y, 'rn', n, lag, n)}) * {(n - 1) / 2}e0"


def norm_slope(q: Sql, y: str, n: int) -> str:
    return slope(q, y, n)


def half_slopes(q: Sql, y: str, n: int) -> str:
    h = n // 2
    return f"({slope(q, y, h)}) - ({slope(q, y, h, n - h)})"


def fam_returns(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    beta = q.div(q.pair("covar_samp", "r", "m", slow, 1, 5), q.roll("var_samp", "m", slow, 1, 5))
    return [
        {"simple_return": simple(q, n), "bench": simple(q, n, "market_close"), "beta": beta, "rv2": q.roll("sum", "r * r", n), "dn2": q.roll("avg", "down * down", n), "mr": q.roll("avg", "r", n), "sr": q.roll("stddev_samp", "r", n),
         "positive_return_sum": q.roll("sum", "up", n, least=1), "negative_return_sum_abs": q.roll("sum", "abs(down)", n, least=1)}
        | {f"return_skip_recent_{f}d_ex_{s}d": q.div(q.lag("close", s), q.lag("close", f)) + " - 1e0" for f, s in SKIPS},
        {"log_return": q.ln("1e0 + simple_return"), "benchmark_excess_return": "simple_return - bench", "beta_residual_return": "simple_return - beta * bench", "return_over_realized_vol": q.div("simple_return", "sqrt(rv2)"),
         "return_over_downside_vol": q.div("simple_return", "sqrt(dn2)"), "return_t_stat": q.div("mr", f"sr / sqrt({n}e0)"), "up_down_return_ratio": q.div("positive_return_sum", "negative_return_sum_abs")},
    ]


#: Formation and skipped sessions of the skip-momentum concepts.
SKIPS = [(5, 1), (10, 1), (20, 1), (20, 5), (30, 5), (40, 5), (63, 5), (63, 20), (126, 20), (252, 20), (252, 63)]


def pct_rank(x: str, key: str = "session_date") -> str:
    """Percentile rank with average ties among the known values of a decision."""
    known = f"PARTITION BY {key}, ({x}) IS NULL"
    return f"CASE WHEN ({x}) IS NOT NULL THEN (CAST(rank() OVER ({known} ORDER BY {x}) AS DOUBLE) + (CAST(count(*) OVER ({known}, {x}) AS DOUBLE) - 1e0) / 2e0) / CAST(count(*) OVER ({known}) AS DOUBLE) END"


def fam_multispeed(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    return [
        {"rf": simple(q, fast), "rs": simple(q, slow), "sf": q.roll("stddev_samp", "r", fast, least=2), "ss": q.roll("stddev_samp", "r", slow)},
        {"fast_minus_slow_return": "rf - rs", "momentum_acceleration": f"rf / {fast}e0 - rs / {slow}e0", "momentum_deceleration": f"-(rf / {fast}e0 - rs / {slow}e0)", "momentum_sign_agreement": "CAST(sign(rf) * sign(rs) AS DOUBLE)",
         "pullback_in_uptrend": "CASE WHEN rf IS NOT NULL AND rs IS NOT NULL THEN CASE WHEN rf < 0 AND rs > 0 THEN abs(rf) * rs ELSE 0e0 END END", "recovery_in_downtrend": "CASE WHEN rf IS NOT NULL AND rs IS NOT NULL THEN CASE WHEN rf > 0 AND rs < 0 THEN rf * abs(rs) ELSE 0e0 END END",
         "fast_minus_slow_cross_sectional_rank": f"({pct_rank('rf')}) - ({pct_rank('rs')})", "fast_minus_slow_risk_adjusted_momentum": f"rf / (sf + {EPS}) - rs / (ss + {EPS})"},
    ]


def fam_path(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    w = n + 1
    h, t = w // 2, w // 3
    fit = q.pair("regr_r2", "lp", "rn", w, 0, w)
    broken = lambda s: q.top(q.each(q.head("signs", "{i}"), f"CASE WHEN y <> {s} THEN {{j}} ELSE 0 END", "y", "j"))
    longest = lambda s: q.div(q.top(q.each("signs", f"CASE WHEN x = {s} THEN CAST({{i}} - {broken(s)} AS DOUBLE) ELSE 0e0 END")), f"{n}e0")
    return [
        {"signs": q.listed("sgn", n), "prices": q.listed("close", w), "path_": q.roll("sum", "abs(dlp)", n, least=n), "first_lp": q.lag("lp", n), "sd_d": q.roll("stddev_samp", "dlp", n, least=n), "sd0_d": q.roll("stddev_pop", "dlp", n, least=n),
         "mean_lp": q.roll("avg", "lp", w, least=w), "mean_p": q.roll("avg", "close", w, least=w), "median_p": q.quantile("close", 0.5, w, least=w), "trend_slope": slope(q, "lp", w), "trend_r2": fit, "abs_sum": q.roll("sum", "ar", n), "net_sum": q.roll("sum", "r", n),
         "same_": "CASE WHEN sgn IS NOT NULL AND sgn1 IS NOT NULL THEN CASE WHEN sgn = sgn1 THEN 1e0 ELSE 0e0 END END", "positive_bar_fraction": q.roll("avg", "CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END END", n), "negative_bar_fraction": q.roll("avg", "CASE WHEN r IS NOT NULL THEN CASE WHEN r < 0 THEN 1e0 ELSE 0e0 END END", n)},
        {"path_efficiency": q.div("abs(lp - first_lp)", "path_"), "trend_slope_t": f"CASE WHEN trend_r2 < 1e0 THEN sign(trend_slope) * sqrt(trend_r2 * {w - 2}e0 / (1e0 - trend_r2)) END", "path_chord_convexity": q.div("(lp + first_lp) / 2e0 - mean_lp", f"sd_d * sqrt({w - 1}e0)"),
         "path_quadratic_curvature": q.div(quadratic(q, w), "sd_d"), "return_acceleration_halves": f"({q.div('close', q.lag('close', h))} - 1e0) - ({q.div(q.lag('close', w - h), q.lag('close', w - 1))} - 1e0)",
         "return_acceleration_thirds": f"({q.div('close', q.lag('close', t))} - 1e0) - ({q.div(q.lag('close', w - t), q.lag('close', w - 1))} - 1e0)", "sign_persistence": q.roll("avg", "same_", n), "gross_to_net_path_ratio": q.div("abs_sum", "abs(net_sum)"),
         "window_max_drawdown": q.bottom(q.each("prices", q.div("x", q.top(q.head("prices", "{i}"))) + " - 1e0")), "window_max_runup": q.top(q.each("prices", q.div("x", q.bottom(q.head("prices", "{i}"))) + " - 1e0")),
         "close_vs_path_mean": f"(close - mean_p) / (close * sd0_d + {EPS})", "close_vs_path_median": f"(close - median_p) / (close * sd0_d + {EPS})",
         "n_runs": f"1e0 + {q.total(q.each('signs', f'CASE WHEN {{i}} > 1 AND x <> {at_before(q)} THEN 1e0 ELSE 0e0 END'))}", "longest_up_run": longest("1e0"), "longest_down_run": longest("-1e0")},
        {"sign_switch_rate": "1e0 - sign_persistence", "average_signed_run_length": "CASE WHEN signs IS NOT NULL THEN 1e0 / n_runs END"},
    ]


def at_before(q: Sql) -> str:
    return q.at("signs", "greatest({i} - 1, 1)")


def quadratic(q: Sql, w: int) -> str:
    """Coefficient of t ** 2 of the least-squares parabola on [-1, 1], from weights that do not depend on the data."""
    t = [2 * k / (w - 1) - 1 for k in range(w)]
    s2, s4 = sum(x**2 for x in t) / w, sum(x**4 for x in t) / w
    c = [(x * x - s2) / (w * (s4 - s2 * s2)) for x in t]
    return " + ".join(f"({v!r}) * {'lp' if k == w - 1 else q.lag('lp', w - 1 - k)}" for k, v in enumerate(c))


def fam_consistency(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    return [
        {"abs_list": q.listed("ar", n), "s": q.roll("sum", "r", n), "a": q.roll("sum", "ar", n), "neg": q.roll("sum", "CASE WHEN r IS NOT NULL THEN CASE WHEN r < 0 THEN 1e0 ELSE 0e0 END END", n), "pos": q.roll("sum", "CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END END", n), "cnt": f"CAST(count(r) {q.over(n)} AS DOUBLE)",
         "sq": q.roll("sum", "r * r", n), "sa": q.roll("sum", "r * ar", n), "mean_": q.roll("avg", "r", n), "median_": q.quantile("r", 0.5, n), "sd0": q.roll("stddev_pop", "r", n)},
        {"information_discreteness": f"sign(s) * {q.div('neg - pos', 'cnt')}", "absolute_return_hhi": q.div("sq", "a * a"), "signed_return_concentration": f"sa / (a * a + {EPS})", "mean_median_return_gap": f"(mean_ - median_) / (sd0 + {EPS})", "largest_abs_return_share": q.div(q.top("abs_list"), "a")}
        | {f"top{k}_abs_return_share": f"CASE WHEN abs_list IS NOT NULL THEN {q.div(q.total(q.head(q.falling('abs_list'), str(k))), 'a')} END" for k in (2, 3, 5)},
    ]


def fam_ranks(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    flag = lambda test: f"CASE WHEN rk IS NOT NULL THEN CASE WHEN rk {test} THEN 1e0 ELSE 0e0 END END"
    dwell = lambda test: q.div(f"{n}e0 - coalesce({q.top(q.each('rks', f'CASE WHEN NOT (x {test}) THEN CAST({{i}} AS DOUBLE) ELSE 0e0 END'))}, 0e0)", f"{n}e0")
    return [
        {"rk": pct_rank("r")},
        {"rks": q.listed("rk", n), "mean_return_rank": q.roll("avg", "rk", n), "median_return_rank": q.quantile("rk", 0.5, n), "return_rank_std": q.roll("stddev_samp", "rk", n), "rank_range": f"({q.roll('max', 'rk', n)}) - ({q.roll('min', 'rk', n)})", "rank_above_80_fraction": q.roll("avg", flag(">= 0.8e0"), n),
         "rank_above_90_fraction": q.roll("avg", flag(">= 0.9e0"), n), "rank_below_20_fraction": q.roll("avg", flag("<= 0.2e0"), n), "return_rank_slope": slope(q, "rk", n), "return_rank_acceleration": half_slopes(q, "rk", 2 * (n // 2))}
        | {f"rank_change_{k}d": f"rk - {q.lag('rk', k)}" for k in (1, 2, 5, 10, 20)},
        {"rank_dwell_top_decile": f"CASE WHEN rks IS NOT NULL THEN {dwell('>= 0.9e0')} END", "rank_dwell_bottom_decile": f"CASE WHEN rks IS NOT NULL THEN {dwell('<= 0.1e0')} END"},
    ]


def fam_location(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    since = lambda best: q.div(f"{n}e0 - {q.top(q.each('ps', f'CASE WHEN x = {best} THEN CAST({{i}} AS DOUBLE) ELSE 0e0 END'))}", f"{n}e0")
    fresh = lambda best, sign: q.div(q.total(q.each("ps", f"CASE WHEN {{i}} = 1 OR x {sign} {best(q.head('ps', '{i} - 1'))} THEN 1e0 ELSE 0e0 END")), f"{n}e0")
    return [
        {"ps": q.listed("close", n), "hi": q.roll("max", "close", n, least=1), "lo": q.roll("min", "close", n, least=1), "ph": q.roll("max", "close", n, 1), "pl": q.roll("min", "close", n, 1), "hn": q.roll("max", "high", n), "ln_": q.roll("min", "low", n), "pph": q.roll("max", "high", n, 1), "ppl": q.roll("min", "low", n, 1), "atr": q.roll("avg", "tr", n)},
        {"range_position": q.div("close - lo", "hi - lo"), "recovery_fraction": q.div("close - lo", "hi - lo"), "distance_from_high": q.div("close", "hi") + " - 1e0", "drawdown_from_high": q.div("close", "hi") + " - 1e0", "distance_from_low": q.div("close", "lo") + " - 1e0", "recovery_from_low": q.div("close", "lo") + " - 1e0",
         "bars_or_days_since_high": since(q.top("ps")), "bars_or_days_since_low": since(q.bottom("ps")), "new_high_count": f"CASE WHEN ps IS NOT NULL THEN {fresh(q.top, '>')} END", "new_low_count": f"CASE WHEN ps IS NOT NULL THEN {fresh(q.bottom, '<')} END", "breakout_distance": f"CASE WHEN ph IS NOT NULL THEN greatest({q.div('close', 'ph')} - 1e0, 0e0) END", "breakdown_distance": f"CASE WHEN pl IS NOT NULL THEN least({q.div('close', 'pl')} - 1e0, 0e0) END",
         "failed_breakout_strength": f"CASE WHEN pph IS NOT NULL THEN CASE WHEN hn > pph AND close <= pph THEN ({q.div('hn', 'pph')} - 1e0) / (atr + {EPS}) ELSE 0e0 END END", "failed_breakdown_strength": f"CASE WHEN ppl IS NOT NULL THEN CASE WHEN ln_ < ppl AND close >= ppl THEN (1e0 - {q.div('ln_', 'ppl')}) / (atr + {EPS}) ELSE 0e0 END END",
         "prior_high_reclaim_strength": f"CASE WHEN pph IS NOT NULL THEN CASE WHEN ln_ < pph AND close > pph THEN ({q.div('close', 'pph')} - 1e0) / (atr + {EPS}) ELSE 0e0 END END", "prior_low_reclaim_strength": f"CASE WHEN ppl IS NOT NULL THEN CASE WHEN hn > ppl AND close < ppl THEN (1e0 - {q.div('close', 'ppl')}) / (atr + {EPS}) ELSE 0e0 END END"},
    ]


def fam_candles(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    span = "high - low"
    return [{"body_to_range": q.div("abs(close - open)", span), "signed_body_to_range": q.div("close - open", span), "upper_wick_fraction": q.div("high - greatest(open, close)", span), "lower_wick_fraction": q.div("least(open, close) - low", span), "close_location_bar": q.div("close - low", span), "true_range_pct": "trp", "high_low_asymmetry": q.div("high + low - open - close", span)}]


def fam_moving_average(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    """Exponential averages are finite sums here: weights (1 - a) ** k over the security's whole past, closed by its first price."""
    k = min(n, max(5, n // 2))
    return [
        {"sma": q.roll("avg", "close", n), "sma_fast": q.roll("avg", "close", fast, least=fast), "sd": q.roll("stddev_samp", "close", n), "sdr": q.roll("stddev_samp", "r", n), "atr": q.roll("avg", "tr", n), "ema": ema(q, "close", n), "ema_fast": ema(q, "close", fast), "ema_slow": ema(q, "close", slow)},
        {"price_to_sma": q.div("close", "sma") + " - 1e0", "price_minus_sma_volnorm": f"(close - sma) / (close * sdr + {EPS})", "sma_slope": q.div(slope(q, "sma", k), "sma"), "sma_acceleration": q.div(half_slopes(q, "sma", 2 * (k // 2)), "sma"), "ema_distance": q.div("close", "ema") + " - 1e0", "ema_slope": q.div(slope(q, "ema", k), "ema"), "bollinger_z": q.div("close - sma", "sd"),
         "atr_band_z": f"(close - sma) / (atr + {EPS})", "fast_slow_sma_gap": q.div("sma_fast", "sma") + " - 1e0", "fast_slow_sma_ratio": f"sma_fast / (sma + {EPS})", "fast_slow_ema_gap": q.div("ema_fast", "ema_slow") + " - 1e0"},
    ]


def ema(q: Sql, x: str, span: int) -> str:
    """Exponential average with a = 2 / (span + 1), started at the first value. What is older than the window weighs less than a double can tell."""
    a = 2 / (span + 1)
    w = q.over(max(math.ceil(37 / -math.log(1 - a)), 2) if a < 1 else 1)
    items = f"collect_list({x}) {w}" if q.spark else f"list({x}) {w}"
    if q.spark:
        return f"aggregate({items}, CAST(NULL AS DOUBLE), (s, x) -> CASE WHEN s IS NULL THEN x ELSE {1 - a!r}D * s + {a!r}D * x END)"
    return f"list_reduce({items}, lambda s, x: {1 - a!r} * s + {a!r} * x)"


def fam_volatility(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    hl, co = q.ln(q.div("high", "low")), q.ln(q.div("close", "open"))
    rs = f"({q.ln(q.div('high', 'close'))}) * ({q.ln(q.div('high', 'open'))}) + ({q.ln(q.div('low', 'close'))}) * ({q.ln(q.div('low', 'open'))})"
    short = max(2, min(5, n // 4))
    return [
        {"beta": q.div(q.pair("covar_samp", "r", "m", slow, 1, 5), q.roll("var_samp", "m", slow, 1, 5)), "sd_short": q.roll("stddev_samp", "r", short, least=short), "sd_n": q.roll("stddev_samp", "r", n), "hl2": f"({hl}) * ({hl})", "co2": f"({co}) * ({co})", "rs_": rs, "realized2": q.roll("sum", "r * r", n, least=min(n, 5)), "dn2": q.roll("avg", "down * down", n), "up2": q.roll("avg", "up * up", n)}
        | {f"{c}_{k}": q.roll("stddev_samp", x, w, least=w) for c, x in (("f", "r"), ("fd", "down"), ("fu", "up")) for k, w in (("fast", fast), ("slow", slow))} | {"atr": q.roll("avg", "tr", n)},
        {"res": "r - beta * m", "close_to_close_vol": "sd_n", "realized_vol": "sqrt(realized2)", "downside_vol": "sqrt(dn2)", "upside_vol": "sqrt(up2)", "down_up_vol_ratio": q.div("sqrt(dn2)", "sqrt(up2)"), "atr_pct": f"atr / (close + {EPS})", "parkinson_vol": f"sqrt(({q.roll('avg', 'hl2', n)}) / (4e0 * ln(2e0)))", "garman_klass_vol": f"sqrt({q.low(q.roll('avg', '0.5e0 * hl2 - (2e0 * ln(2e0) - 1e0) * co2', n), '0e0')})",
         "rogers_satchell_vol": f"sqrt({q.low(q.roll('avg', 'rs_', n), '0e0')})", "vol_of_vol": q.roll("stddev_samp", "sd_short", n), "vols": q.listed("sd_n", n + 1), "vol_acceleration": q.div("f_fast", "f_slow") + " - 1e0", "vol_compression_ratio": q.div("f_fast", "f_slow") + " - 1e0", "downside_vol_acceleration": q.div("fd_fast", "fd_slow") + " - 1e0", "upside_vol_acceleration": q.div("fu_fast", "fu_slow") + " - 1e0"},
        {"idiosyncratic_vol": q.roll("stddev_samp", "res", n), "vol_percentile_own": q.div(f"{q.size(q.only('vols', 'x <= sd_n'))} - 1e0", f"{n}e0")},
    ]


def fam_distribution(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    jump = "abs(x - med) > 3e0 * 1.4826e0 * mad"
    return [
        {"rsn": q.listed("r", n), "mean_": q.roll("avg", "r", n), "sd0": q.roll("stddev_pop", "r", n), "downside_semivariance": q.roll("avg", "down * down", n), "upside_semivariance": q.roll("avg", "up * up", n), "max_subreturn": q.roll("max", "r", n), "min_subreturn": q.roll("min", "r", n), "p95_subreturn": q.quantile("r", 0.95, n), "p05_subreturn": q.quantile("r", 0.05, n), "med": q.quantile("r", 0.5, n, 1, n), "prior": q.listed("r", n, 1)},
        {"m3": q.total(q.each("rsn", "(x - mean_) * (x - mean_) * (x - mean_)")), "m4": q.total(q.each("rsn", "(x - mean_) * (x - mean_) * (x - mean_) * (x - mean_)")), "semivariance_ratio": q.div("downside_semivariance", "upside_semivariance"), "tail_spread": "p95_subreturn - p05_subreturn", "lows": q.only("rsn", "x <= p05_subreturn"), "highs": q.only("rsn", "x >= p95_subreturn"), "devs": q.falling(q.each("prior", "abs(x - med)")), "sq": q.total(q.each("rsn", "x * x"))},
        {"realized_skewness": f"CASE WHEN rsn IS NOT NULL THEN {q.div(f'm3 / {n}e0', 'sd0 * sd0 * sd0')} END", "realized_kurtosis": f"CASE WHEN rsn IS NOT NULL THEN {q.div(f'm4 / {n}e0', 'sd0 * sd0 * sd0 * sd0')} END", "left_expected_shortfall": q.div(q.total("lows"), q.size("lows")), "right_expected_shortfall": q.div(q.total("highs"), q.size("highs")), "mad": f"({q.at('devs', str((n + 1) // 2))} + {q.at('devs', str(n // 2 + 1))}) / 2e0"},
        {"jumps": q.only("rsn", jump)},
        {"jump_fraction": f"{q.size('jumps')} / {n}e0", "positive_jump_fraction": f"{q.size(q.only('jumps', 'x > 0'))} / {n}e0", "negative_jump_fraction": f"{q.size(q.only('jumps', 'x < 0'))} / {n}e0", "jump_variance_share": q.div(q.total(q.each("jumps", "x * x")), "sq")},
    ]


def fam_serial(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    lagged = {f"r_{k}": q.lag("r", k) for k in (1, 2, 3, 4)} | {"s_1": q.lag("sgn"), "a_1": q.lag("ar")}
    plogp = lambda p: f"CASE WHEN ({p}) > 0 THEN -({p}) * ln({p}) ELSE 0e0 END"
    order = "CASE WHEN r IS NOT NULL AND r_2 IS NOT NULL AND r_1 IS NOT NULL THEN CASE WHEN r_2 <= r_1 AND r_1 <= r THEN 0 WHEN r_2 <= r AND r < r_1 THEN 1 WHEN r_1 < r_2 AND r_2 <= r THEN 2 WHEN r < r_2 AND r_2 <= r_1 THEN 3 WHEN r_1 <= r AND r < r_2 THEN 4 ELSE 5 END END"
    share = lambda t, of, w: f"({q.roll('avg', f'CASE WHEN {of} IS NOT NULL THEN CASE WHEN {of} = {t} THEN 1e0 ELSE 0e0 END END', w, least=w)})"
    return [
        lagged,
        {"s2": "r + r_1", "s4": "r + r_1 + r_2 + r_3", "s5": "r + r_1 + r_2 + r_3 + r_4", "pattern": order, "v1": q.roll("var_samp", "r", n, least=n)},
        {f"return_autocorr_lag{k}": q.pair("corr", "r", f"r_{k}", n - k, 0, n - k) for k in (1, 2, 3)}
        | {"sign_autocorr_lag1": q.pair("corr", "sgn", "s_1", n - 1, 0, n - 1), "abs_return_autocorr_lag1": q.pair("corr", "ar", "a_1", n - 1, 0, n - 1), "variance_ratio_2": f"({q.roll('var_samp', 's2', n - 1, least=n - 1)}) / (2e0 * v1 + {EPS})", "variance_ratio_5": f"({q.roll('var_samp', 's5', max(n - 4, 2), least=max(n - 4, 2))}) / (5e0 * v1 + {EPS})"}
        | {f"p{k}": share(t, "sgn", n) for k, t in enumerate(("-1e0", "0e0", "1e0"))} | {f"o{k}": share(str(k), "pattern", n - 2) for k in range(6)} | {"w2": q.roll("var_pop", "s2", n - 1, least=n - 1), "w4": q.roll("var_pop", "s4", max(n - 3, 2), least=max(n - 3, 2)), "w1": q.roll("var_pop", "r", n, least=n)},
        {"return_entropy": " + ".join(plogp(f"p{k}") for k in range(3)), "permutation_entropy": "(" + " + ".join(plogp(f"o{k}") for k in range(6)) + ") / ln(6e0)", "hurst_exponent": f"CASE WHEN w1 > 0 AND w2 > 0 AND w4 > 0 THEN (ln(w4) - ln(w1)) / (4e0 * ln(2e0)) END"},
        {"sign_entropy": "return_entropy"},
    ]


def fam_volume(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    return [
        {"vs": q.listed("volume", n), "raw_volume": q.roll("sum", "volume", n, least=1), "dollar_volume": q.roll("sum", "dollar", n, least=1), "ev": q.roll("avg", "volume", n, 1), "ed": q.roll("avg", "dollar", n, 1), "sv": q.roll("stddev_samp", "volume", n, 1), "sdd": q.roll("stddev_samp", "dollar", n, 1), "sum_v": q.roll("sum", "volume", n), "mx": q.roll("max", "volume", n), "sq": q.roll("sum", "volume * volume", n),
         "upv": q.roll("sum", "CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN volume ELSE 0e0 END END", n), "dnv": q.roll("sum", "CASE WHEN r IS NOT NULL THEN CASE WHEN r < 0 THEN volume ELSE 0e0 END END", n), "volume_trend": slope(q, "lv", n), "volume_acceleration": half_slopes(q, "lv", 2 * (n // 2)), "volume_volatility": q.roll("stddev_samp", "dv", n), "trade_count_": q.roll("sum", "trade_count", n), "etc": q.roll("avg", "trade_count", n, 1)},
        {"relative_volume": f"volume / (ev + {EPS})", "relative_dollar_volume": f"dollar / (ed + {EPS})", "volume_zscore": f"(volume - ev) / (sv + {EPS})", "dollar_volume_zscore": f"(dollar - ed) / (sdd + {EPS})", "volume_percentile_own": q.div(q.size(q.only("vs", "x <= volume")), f"{n}e0"), "up_bar_volume_share": f"upv / (sum_v + {EPS})", "down_bar_volume_share": f"dnv / (sum_v + {EPS})",
         "volume_concentration": q.div("sq", "sum_v * sum_v"), "largest_bar_volume_share": f"mx / (sum_v + {EPS})", "trade_count_sum": "trade_count_", "relative_trade_count": q.div("trade_count", "etc"), "average_trade_size": q.div("sum_v", "trade_count_")},
    ]


def fam_liquidity(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    k = 3 - 2 * 2**0.5
    return [
        {"amihud_illiquidity": q.roll("avg", q.div("ar", "dollar"), n), "hn": q.roll("max", "high", n), "ln_": q.roll("min", "low", n), "sd_": q.roll("sum", "dollar", n), "first_": q.lag("close", n), "simple_": simple(q, n), "dp1": q.lag("dp"),
         "b_": f"pow({q.ln(q.div('high', 'low'))}, 2e0) + pow({q.ln(q.div('prior_high', 'prior_low'))}, 2e0)", "g_": f"CASE WHEN prior_high IS NOT NULL THEN pow({q.ln(q.div('greatest(high, prior_high)', 'least(low, prior_low)'))}, 2e0) END"},
        {"alpha_": f"(sqrt(2e0 * b_) - sqrt(b_)) / {k!r} - sqrt(g_ / {k!r})", "range_per_dollar_volume": f"({q.div('hn - ln_', 'first_')}) / (sd_ + {EPS})", "abs_return_per_dollar_volume": q.div("abs(simple_)", "sd_"), "cov_": q.pair("covar_samp", "dp", "dp1", n - 1, 0, n - 1)},
        {"cs_": q.low("2e0 * (exp(alpha_) - 1e0) / (1e0 + exp(alpha_))", "0e0"), "roll_spread_proxy": q.div(f"2e0 * sqrt({q.low('-cov_', '0e0')})", "close")},
        {"corwin_schultz_spread_proxy": q.quantile("cs_", 0.5, n - 1, least=n - 1)},
    ]


def fam_price_volume(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    return [
        {"simple_": simple(q, n), "ev": q.roll("avg", "volume", n, 1), "sv": q.roll("stddev_samp", "volume", n, 1), "svb": q.roll("sum", "sgn * volume", n), "sum_v": q.roll("sum", "volume", n), "svw": q.roll("sum", "vwap * volume", n), "sd_": q.roll("sum", "dollar", n), "obv": f"sum(coalesce(sgn, 0e0) * volume) {q.over(None)}", "return_volume_corr": q.pair("corr", "r", "lv", n), "absreturn_volume_corr": q.pair("corr", "ar", "lv", n), "mf": q.roll("sum", "dtyp * volume", n)},
        {"zv": f"(volume - ev) / (sv + {EPS})", "es": q.roll("avg", "simple_", n, 1), "ss": q.roll("stddev_samp", "simple_", n, 1)},
        {"return_x_rvol": f"simple_ * volume / (ev + {EPS})", "abs_return_x_rvol": f"abs(simple_) * volume / (ev + {EPS})", "return_x_volume_z": "simple_ * zv", "signed_volume_balance": q.div("svb", "sum_v"), "obv_slope": slope(q, "obv", n), "price_shock_minus_volume_shock": f"(simple_ - es) / (ss + {EPS}) - zv", "volume_shock_minus_price_shock": f"zv - (simple_ - es) / (ss + {EPS})", "close_vs_vwap": q.div(f"close - {q.div('svw', 'sum_v')}", "close"), "vwap_drift": slope(q, "vwap", n), "money_flow_proxy": f"mf / (sd_ + {EPS})"},
    ]


def fam_session(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    return [
        {"atrp": q.roll("avg", "trp", n), "sdr": q.roll("stddev_samp", "r", n), "positive_overnight_fraction": q.roll("avg", "CASE WHEN overnight IS NOT NULL THEN CASE WHEN overnight > 0 THEN 1e0 ELSE 0e0 END END", n), "positive_regular_fraction": q.roll("avg", "CASE WHEN regular > 0 THEN 1e0 ELSE 0e0 END", n)},
        {"overnight_return": "overnight", "opening_gap": "overnight", "regular_session_return": "regular", "overnight_minus_regular": "overnight - regular", "overnight_share_total": f"overnight / (abs(overnight) + abs(regular) + {EPS})", "gap_vs_atr": q.div("overnight", "atrp"), "gap_vs_prior_vol": f"overnight / (sdr + {EPS})", "gap_fill_fraction_eod": q.low(q.high(q.div("open - close", "open - prior_close"), "2e0"), "-2e0"), "close_location_daily_range": q.div("close - low", "high - low"), "session_vwap_distance": q.div("close - vwap", "close")},
    ]


def fam_market(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    side = lambda test: q.div(q.pair("covar_samp", f"CASE WHEN m {test} THEN r END", f"CASE WHEN m {test} THEN m END", slow, 1, 2), q.finite(f"var_samp(CASE WHEN m {test} AND r IS NOT NULL THEN m END) {q.over(slow, 1)}"))
    beta = q.div(q.pair("covar_samp", "r", "m", slow, 1, 5), q.roll("var_samp", "m", slow, 1, 5))
    t = "OVER (PARTITION BY session_date)"
    c = lambda x: f"CAST(count({x}) {t} AS DOUBLE)"
    return [
        {"simple_": simple(q, n), "market_return": simple(q, n, "market_close"), "market_beta": beta, "downside_beta": side("< 0"), "upside_beta": side("> 0"), "market_correlation": q.pair("corr", "r", "m", n), "mm": q.roll("max", "market_close", n), "market_volatility": q.roll("stddev_samp", "m", n), "market_downside_vol": q.roll("stddev_samp", "CASE WHEN m IS NOT NULL THEN least(m, 0e0) END", n),
         "market_lead_response": q.pair("regr_slope", "r", "m1", n), "stock_lead_market_response": q.pair("regr_slope", "m", "r1", n), "market_gap": "market_gap_", "market_intraday_return": q.div("market_close", "market_open") + " - 1e0"}
        | {f"sma{k}": q.roll("avg", "close", k) for k in (20, 50, 100, 200)},
        {"beta_change": f"market_beta - {q.lag('market_beta', fast)}", "correlation_change": f"market_correlation - {q.lag('market_correlation', fast)}", "market_risk_adjusted_momentum": q.div("market_return", "market_volatility"), "market_drawdown": q.div("market_close", "mm") + " - 1e0", "mvols": q.listed("market_volatility", n + 1), "res_": "simple_ - market_beta * market_return",
         "market_breadth_positive": f"avg(CASE WHEN simple_ IS NOT NULL THEN CASE WHEN simple_ > 0 THEN 1e0 ELSE 0e0 END END) {t}", "cross_sectional_return_dispersion": f"stddev_samp(simple_) {t}", "xs_n": c("simple_"), "xs_m": f"avg(simple_) {t}", "average_pairwise_correlation": f"avg(market_correlation) {t}", "beta_dispersion": f"stddev_samp(market_beta) {t}"}
        | {f"market_breadth_above_sma{k}": f"avg(CASE WHEN sma{k} IS NOT NULL THEN CASE WHEN close > sma{k} THEN 1e0 ELSE 0e0 END END) {t}" for k in (20, 50, 100, 200)},
        {"market_vol_percentile": q.div(f"{q.size(q.only('mvols', 'x <= market_volatility'))} - 1e0", f"{n}e0"), "cross_sectional_residual_dispersion": f"stddev_samp(res_) {t}", "k2": f"avg(pow(simple_ - xs_m, 2e0)) {t}", "k3": f"avg(pow(simple_ - xs_m, 3e0)) {t}", "k4": f"avg(pow(simple_ - xs_m, 4e0)) {t}", "breadth_change": f"market_breadth_positive - {q.lag('market_breadth_positive', fast)}", "breadth_momentum": slope(q, "market_breadth_positive", n)},
        {"cross_sectional_return_skew": f"CASE WHEN xs_n > 2 THEN sqrt(xs_n * (xs_n - 1e0)) / (xs_n - 2e0) * {q.div('k3', 'pow(k2, 1.5e0)')} END", "cross_sectional_return_kurtosis": f"CASE WHEN xs_n > 3 THEN (xs_n - 1e0) / ((xs_n - 2e0) * (xs_n - 3e0)) * ((xs_n + 1e0) * {q.div('k4', 'k2 * k2')} - 3e0 * (xs_n - 1e0)) END"},
    ]


def fam_calendar(q: Sql, n: int, fast: int, slow: int) -> list[dict[str, str]]:
    """On days; the minute's angle is that of the day's last availability in the input (column minute)."""
    days = (lambda a, b: f"datediff({a}, {b})") if q.spark else (lambda a, b: f"date_diff('day', {b}, {a})")
    quarter = "last_day(add_months(trunc(session_date, 'quarter'), 2))" if q.spark else "last_day(CAST(date_trunc('quarter', session_date) + INTERVAL 2 MONTH AS DATE))"
    dow = "weekday(session_date)" if q.spark else "isodow(session_date) - 1"
    gap = lambda fn: f"CAST({days(f'{fn}(session_date) OVER (PARTITION BY {q.key} ORDER BY session_date)', 'session_date')} AS DOUBLE)"
    return [
        {"angle": "2e0 * pi() * least(390e0, minute - 570e0) / 390e0", "day_of_week": f"CAST({dow} AS DOUBLE)", "month_end_distance": f"CAST({days('last_day(session_date)', 'session_date')} AS DOUBLE)", "quarter_end_distance": f"CAST({days(quarter, 'session_date')} AS DOUBLE)", "to_next": gap("lead"), "to_prior": gap("lag")},
        {"minute_of_day_sin": "sin(angle)", "minute_of_day_cos": "cos(angle)", "pre_holiday_flag": "CASE WHEN to_next IS NOT NULL THEN CASE WHEN to_next > CASE WHEN day_of_week = 4 THEN 3 ELSE 1 END THEN 1e0 ELSE 0e0 END END", "post_holiday_flag": "CASE WHEN to_prior IS NOT NULL THEN CASE WHEN -to_prior > CASE WHEN day_of_week = 0 THEN 3 ELSE 1 END THEN 1e0 ELSE 0e0 END END"},
    ]


#: Intermediate columns of a family that are no concept.
PRIVATE = {
    "returns": ["bench", "beta", "rv2", "dn2", "mr", "sr"],
    "multispeed": ["rf", "rs", "sf", "ss"],
    "path": ["signs", "prices", "path_", "first_lp", "sd_d", "sd0_d", "mean_lp", "mean_p", "median_p", "abs_sum", "net_sum", "same_", "n_runs"],
    "consistency": ["abs_list", "s", "a", "neg", "pos", "cnt", "sq", "sa", "mean_", "median_", "sd0"],
    "ranks": ["rk", "rks"],
    "location": ["ps", "hi", "lo", "ph", "pl", "hn", "ln_", "pph", "ppl", "atr"],
    "candles": [],
    "moving_average": ["sma", "sma_fast", "sd", "sdr", "atr", "ema", "ema_fast", "ema_slow"],
    "volatility": ["beta", "sd_short", "sd_n", "hl2", "co2", "rs_", "realized2", "dn2", "up2", "f_fast", "f_slow", "fd_fast", "fd_slow", "fu_fast", "fu_slow", "atr", "res", "vols"],
    "distribution": ["rsn", "mean_", "sd0", "med", "prior", "m3", "m4", "lows", "highs", "devs", "sq", "mad", "jumps"],
    "serial": ["r_1", "r_2", "r_3", "r_4", "s_1", "a_1", "s2", "s4", "s5", "pattern", "v1", "p0", "p1", "p2", "o0", "o1", "o2", "o3", "o4", "o5", "w1", "w2", "w4"],
    "volume": ["vs", "ev", "ed", "sv", "sdd", "sum_v", "mx", "sq", "upv", "dnv", "trade_count_", "etc"],
    "liquidity": ["hn", "ln_", "sd_", "first_", "simple_", "dp1", "b_", "g_", "alpha_", "cov_", "cs_"],
    "price_volume": ["simple_", "ev", "sv", "svb", "sum_v", "svw", "sd_", "obv", "mf", "zv", "es", "ss"],
    "session": ["atrp", "sdr"],
    "market": ["simple_", "mm", "sma20", "sma50", "sma100", "sma200", "mvols", "res_", "xs_n", "xs_m", "k2", "k3", "k4"],
    "calendar": ["angle", "to_next", "to_prior"],
}
FAMILIES: dict[str, Callable[[Sql, int, int, int], list[dict[str, str]]]] = {
    "returns": fam_returns, "multispeed": fam_multispeed, "path": fam_path, "consistency": fam_consistency, "ranks": fam_ranks, "location": fam_location, "candles": fam_candles, "moving_average": fam_moving_average, "volatility": fam_volatility,
    "distribution": fam_distribution, "serial": fam_serial, "volume": fam_volume, "liquidity": fam_liquidity, "price_volume": fam_price_volume, "session": fam_session, "market": fam_market, "calendar": fam_calendar,
}


def stages(family: str, q: Sql, n: int = 6, fast: int = 3, slow: int = 10) -> list[dict[str, str]]:
    own = [s for s in FAMILIES[family](q, n, fast, slow) if s]
    base = [f(q) for f in BASE]
    if family == "path":
        base.append({"sgn1": q.lag("sgn")})
    return base + own


def concepts(family: str) -> list[str]:
    hidden = set(PRIVATE[family])
    return [k for s in FAMILIES[family](Sql(), 6, 3, 10) for k in s if k not in hidden]


def at_scales(family: str, q: Sql, scales: list[tuple[int, int, int]]) -> tuple[list[dict[str, str]], list[str]]:
    """A family at several (window, fast, slow) at once: its stages with the scale after each name, so that all scales share sorts, and the concepts' names."""
    made, names = [], []
    for n, fast, slow in scales:
        own = [s for s in FAMILIES[family](q, n, fast, slow) if s]
        of = {k for s in own for k in s}
        tail = f"_{n}_{fast}_{slow}"
        rename = lambda text: re.sub(r"\b(" + "|".join(sorted(of, key=len, reverse=True)) + r")\b(?!\()", lambda m: m[1] + tail, text)  # noqa: B023, E731
        made.append([{k + tail: rename(x) for k, x in s.items()} for s in own])
        names += [k + tail for k in concepts(family)]
    base = [f(q) for f in BASE] + ([{"sgn1": q.lag("sgn")}] if family == "path" else [])
    return base + [{k: x for s in same for k, x in s.items()} for same in zip(*made, strict=True)], names


def catalogue() -> list[tuple[str, str]]:
    return [(f, c) for f in FAMILIES for c in concepts(f)]


__all__ = ["FAMILIES", "catalogue", "concepts", "pct_rank", "required", "stages"]
