"""Two or more concepts of every family against pandas, written from the concepts' definitions and not from the formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import features
from tidemark.plans import staged
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"
N, FAST, SLOW = 6, 3, 10


@pytest.fixture(scope="module")
def bars(spark):
    b = tables.bars(spark, SF)
    out = b.toPandas().sort_values(["security_id", "session_date"]).reset_index(drop=True)
    return out


@pytest.fixture(scope="module")
def made(spark):
    def of(family):
        b = tables.bars(spark, SF)
        if family == "calendar":
            b = b.selectExpr("*", "570e0 + pmod(security_id, 390) AS minute")
        got = staged.run(b, lambda q: features.stages(family, q, N, FAST, SLOW), ["security_id", "session_date"], features.concepts(family), 9).toPandas()
        return got.sort_values(["security_id", "session_date"]).reset_index(drop=True)

    return of


def per(b, f):
    """f of each security's rows, in their order."""
    return pd.concat([f(g) for _, g in b.groupby("security_id")]).sort_index()


def need(n):
    return min(n, max(5, int(np.ceil(0.6 * n))))


def roll(x, n=N, least=None):
    return x.rolling(n, min_periods=need(n) if least is None else least)


def ret(g):
    return g["close"] / g["close"].shift().replace(0, np.nan) - 1


def rank_now(b, x):
    return x.groupby(b["session_date"]).rank(pct=True)


def cov(x, y, n, least):
    """Covariance and variance of y over the n rows before each row, on rows where both are known."""
    both = x.notna() & y.notna()
    out = []
    for k in range(len(x)):
        s = slice(max(k - n, 0), k)
        a, c = x.iloc[s][both.iloc[s]], y.iloc[s][both.iloc[s]]
        out.append((np.cov(a, c)[0, 1], c.var()) if len(a) >= least else (np.nan, np.nan))
    return pd.DataFrame(out, index=x.index, columns=["cov", "var"])


def max_drawdown(p):
    return min(v / max(p[: k + 1]) - 1 for k, v in enumerate(p))


DEFINITIONS = {
    "returns": {
        "simple_return": lambda b: per(b, lambda g: g["close"] / g["close"].shift(N) - 1),
        "log_return": lambda b: per(b, lambda g: np.log(g["close"] / g["close"].shift(N))),
        "benchmark_excess_return": lambda b: per(b, lambda g: g["close"] / g["close"].shift(N) - g["market_close"] / g["market_close"].shift(N)),
        "return_skip_recent_5d_ex_1d": lambda b: per(b, lambda g: g["close"].shift(1) / g["close"].shift(5) - 1),
    },
    "multispeed": {
        "momentum_acceleration": lambda b: per(b, lambda g: (g["close"] / g["close"].shift(FAST) - 1) / FAST - (g["close"] / g["close"].shift(SLOW) - 1) / SLOW),
        "fast_minus_slow_return": lambda b: per(b, lambda g: g["close"] / g["close"].shift(FAST) - g["close"] / g["close"].shift(SLOW)),
    },
    "path": {
        "window_max_drawdown": lambda b: per(b, lambda g: g["close"].rolling(N + 1).apply(max_drawdown, raw=True)),
        "path_efficiency": lambda b: per(b, lambda g: (np.log(g["close"]) - np.log(g["close"].shift(N))).abs() / np.log(g["close"]).diff().abs().rolling(N).sum()),
        "positive_bar_fraction": lambda b: per(b, lambda g: roll((ret(g) > 0).astype(float).where(ret(g).notna())).mean()),
    },
    "consistency": {
        "absolute_return_hhi": lambda b: per(b, lambda g: roll(ret(g) ** 2).sum() / roll(ret(g).abs()).sum() ** 2),
        "mean_median_return_gap": lambda b: per(b, lambda g: (roll(ret(g)).mean() - roll(ret(g)).median()) / (roll(ret(g)).std(ddof=0) + 1e-12)),
    },
    "ranks": {
        "mean_return_rank": lambda b: per(b.assign(k=rank_now(b, per(b, ret))), lambda g: roll(g["k"]).mean()),
        "rank_change_2d": lambda b: per(b.assign(k=rank_now(b, per(b, ret))), lambda g: g["k"] - g["k"].shift(2)),
    },
    "location": {
        "range_position": lambda b: per(b, lambda g: (g["close"] - roll(g["close"], least=1).min()) / (roll(g["close"], least=1).max() - roll(g["close"], least=1).min()).replace(0, np.nan)),
        "drawdown_from_high": lambda b: per(b, lambda g: g["close"] / roll(g["close"], least=1).max() - 1),
        "bars_or_days_since_high": lambda b: per(b, lambda g: g["close"].rolling(N).apply(lambda p: (N - 1 - max(k for k, v in enumerate(p) if v == max(p))) / N, raw=True)),
    },
    "candles": {
        "body_to_range": lambda b: (b["close"] - b["open"]).abs() / (b["high"] - b["low"]).replace(0, np.nan),
        "upper_wick_fraction": lambda b: (b["high"] - b[["open", "close"]].max(axis=1)) / (b["high"] - b["low"]).replace(0, np.nan),
    },
    "moving_average": {
        "price_to_sma": lambda b: per(b, lambda g: g["close"] / roll(g["close"]).mean() - 1),
        "ema_distance": lambda b: per(b, lambda g: g["close"] / g["close"].ewm(span=N, adjust=False).mean() - 1),
        "fast_slow_ema_gap": lambda b: per(b, lambda g: g["close"].ewm(span=FAST, adjust=False).mean() / g["close"].ewm(span=SLOW, adjust=False).mean() - 1),
    },
    "volatility": {
        "close_to_close_vol": lambda b: per(b, lambda g: roll(ret(g)).std()),
        "realized_vol": lambda b: per(b, lambda g: np.sqrt(roll(ret(g) ** 2).sum())),
        "parkinson_vol": lambda b: per(b, lambda g: np.sqrt(roll(np.log(g["high"] / g["low"]) ** 2).mean() / (4 * np.log(2)))),
        "downside_vol": lambda b: per(b, lambda g: np.sqrt(roll(ret(g).clip(upper=0) ** 2).mean())),
    },
    "distribution": {
        "realized_skewness": lambda b: per(b, lambda g: ret(g).rolling(N).apply(lambda x: np.mean((x - x.mean()) ** 3) / np.std(x) ** 3, raw=True)),
        "tail_spread": lambda b: per(b, lambda g: roll(ret(g)).quantile(0.95) - roll(ret(g)).quantile(0.05)),
        "downside_semivariance": lambda b: per(b, lambda g: roll(ret(g).clip(upper=0) ** 2).mean()),
    },
    "serial": {
        "return_autocorr_lag1": lambda b: per(b, lambda g: ret(g).rolling(N).apply(lambda x: np.corrcoef(x[1:], x[:-1])[0, 1], raw=True)),
        "variance_ratio_2": lambda b: per(b, lambda g: (ret(g) + ret(g).shift()).rolling(N - 1).var().where(ret(g).rolling(N).count() >= 0) / (2 * ret(g).rolling(N).var() + 1e-12)),
    },
    "volume": {
        "relative_volume": lambda b: per(b, lambda g: g["volume"] / (roll(g["volume"].shift()).mean() + 1e-12)),
        "volume_concentration": lambda b: per(b, lambda g: roll(g["volume"] ** 2).sum() / roll(g["volume"]).sum() ** 2),
    },
    "liquidity": {
        "amihud_illiquidity": lambda b: per(b, lambda g: roll(ret(g).abs() / g["dollar"].replace(0, np.nan)).mean()),
        "roll_spread_proxy": lambda b: per(b, lambda g: 2 * np.sqrt((-g["close"].diff().rolling(N - 1).cov(g["close"].diff().shift())).clip(lower=0)) / g["close"]),
    },
    "price_volume": {
        "close_vs_vwap": lambda b: per(b, lambda g: (g["close"] - roll(g["vwap"] * g["volume"]).sum() / roll(g["volume"]).sum()) / g["close"]),
        "signed_volume_balance": lambda b: per(b, lambda g: roll(np.sign(ret(g)) * g["volume"]).sum() / roll(g["volume"]).sum()),
    },
    "session": {
        "overnight_return": lambda b: per(b, lambda g: g["open"] / g["close"].shift() - 1),
        "overnight_minus_regular": lambda b: per(b, lambda g: g["open"] / g["close"].shift() - g["close"] / g["open"]),
        "gap_fill_fraction_eod": lambda b: per(b, lambda g: ((g["open"] - g["close"]) / (g["open"] - g["close"].shift()).replace(0, np.nan)).clip(-2, 2)),
    },
    "market": {
        "market_return": lambda b: per(b, lambda g: g["market_close"] / g["market_close"].shift(N) - 1),
        "market_beta": lambda b: per(b, lambda g: (lambda c: c["cov"] / c["var"])(cov(ret(g), g["market_close"] / g["market_close"].shift() - 1, SLOW, 5))),
        "cross_sectional_return_dispersion": lambda b: per(b, lambda g: g["close"] / g["close"].shift(N) - 1).groupby(b["session_date"]).transform("std"),
    },
    "calendar": {
        "day_of_week": lambda b: pd.to_datetime(b["session_date"]).dt.weekday.astype(float),
        "month_end_distance": lambda b: (pd.to_datetime(b["session_date"]) + pd.offsets.MonthEnd(0) - pd.to_datetime(b["session_date"])).dt.days.astype(float),
    },
}


def test_every_family_has_definitions():
    assert set(DEFINITIONS) == set(features.FAMILIES)
    known = set(features.catalogue())
    assert all((f, c) in known for f, own in DEFINITIONS.items() for c in own)


@pytest.mark.parametrize("family", sorted(DEFINITIONS))
def test_concepts_equal_their_definitions(bars, made, family):
    got = made(family)
    for concept, define in DEFINITIONS[family].items():
        want = define(bars).to_numpy(float)
        want[~np.isfinite(want)] = np.nan
        have = got[concept].to_numpy(float)
        assert np.isfinite(want).sum() > 30, concept
        np.testing.assert_allclose(have, want, rtol=1e-6, atol=2e-8, err_msg=concept)


@pytest.mark.parametrize("family", ["multispeed", "path", "volatility", "serial"])
def test_scales_at_once_equal_one_by_one(spark, family):
    from tidemark.functions.sqltext import SPARK

    b = tables.bars(spark, SF)
    scales = [(5, 2, 8), (8, 3, 12)]
    stages, names = features.at_scales(family, SPARK, scales)
    key = ["security_id", "session_date"]
    both = staged.apply(b, stages).selectExpr(*staged.outputs(key, names, SPARK, 9)).toPandas().sort_values(key).reset_index(drop=True)
    for n, fast, slow in scales:
        one = staged.run(b, lambda q: features.stages(family, q, n, fast, slow), key, features.concepts(family), 9).toPandas().sort_values(key).reset_index(drop=True)
        for c in features.concepts(family):
            np.testing.assert_allclose(both[f"{c}_{n}_{fast}_{slow}"].to_numpy(float), one[c].to_numpy(float), rtol=1e-9, err_msg=c)
