"""The clock pack at its full lengths, against plain computations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.sqltext import SPARK
from tidemark.operators.clock import BLOCKS, Pack
from tidemark.plans import staged


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(8)
    rows = []
    for s in range(3):
        for d in range(24):
            close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 40)))
            for m in range(40):
                o = close[m - 1] if m else close[0]
                rows.append((s, d, m, o, max(o, close[m]) * 1.001, min(o, close[m]) * 0.999, close[m], float(rng.integers(100, 900)), close[m], float(rng.integers(1, 30))))
    df = pd.DataFrame(rows, columns=["security_id", "session_no", "minute", "open", "high", "low", "close", "volume", "vwap", "trade_count"])
    df["market"] = df.groupby(["session_no", "minute"])["close"].transform("mean")
    df["prior_session_close"] = df["close"]
    return df


@pytest.fixture(scope="module")
def wide(spark, bars):
    pack = Pack(SPARK, hist=3, beta_sessions=2, beta_least=20)
    names = sorted({x for block in BLOCKS.values() for x in block} | {"e_1", "range_1", "tail98", "tail96", "ss30"})
    return staged.apply(spark.createDataFrame(bars), pack.stages()).select("security_id", "session_no", "minute", *names).toPandas().sort_values(["security_id", "session_no", "minute"]).reset_index(drop=True)


def equal(a, b):
    assert b.notna().sum() > 20
    np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-12)


def test_lengths_are_what_the_names_say(bars, wide):
    close = bars.groupby(["security_id", "session_no"])["close"]
    equal(wide["breakout_dist_high_15m"], bars["close"] / close.transform(lambda x: x.shift().rolling(15).max()) - 1)
    equal(wide["breakout_dist_low_15m"], bars["close"] / close.transform(lambda x: x.shift().rolling(15).min()) - 1)
    own = wide.groupby(["security_id", "session_no"])
    equal(wide["range_ratio_5_30"], own["range_1"].transform(lambda x: x.rolling(5).sum() / (x.shift(5).rolling(30).sum() * 5 / 30)))
    equal(wide["ss30"], own["e_1"].transform(lambda x: np.sqrt((x * x).shift().rolling(30).sum())))
    equal(wide["tail_event_count_15m"], own["tail98"].transform(lambda x: x.rolling(15).sum()))
    equal(wide["shock_cluster_score_15m"], own["tail96"].transform(lambda x: sum(np.exp(-k / 5) * x.shift(k) for k in range(1, 16))))
    equal(wide["same_minute_resid_mean20d"], wide.groupby(["security_id", "minute"])["e_1"].transform(lambda x: x.shift().rolling(20).mean()))


def test_all_targets(spark, bars, wide):
    from pyspark.sql import functions as F

    from tidemark.operators.clock import FACTOR_TARGETS
    from tidemark.operators.factors import factor_block, loadings, pairwise_covariance, residuals

    assert len({*BLOCKS["targets"], *FACTOR_TARGETS}) == 31
    close = bars.groupby(["security_id", "session_no"])["close"]
    equal(wide["fwd_raw_30m"], close.transform(lambda x: x.shift(-30)) / bars["close"] - 1)
    stages = Pack(SPARK, hist=3, beta_sessions=2, beta_least=20).target_stages()
    got = factor_block(staged.apply(spark.createDataFrame(bars.query("session_no < 6")), stages), 4, 1, 2, project=FACTOR_TARGETS).where(F.col("session_no") == 5).toPandas()
    r1 = close.transform(lambda x: x / x.shift() - 1)
    cube = lambda x: pd.DataFrame({"d": bars["session_no"], "m": bars["minute"], "s": bars["security_id"], "x": x}).pivot(index=["d", "m"], columns="s", values="x")
    past = cube(r1).loc[1:4].to_numpy()
    v = loadings(pairwise_covariance(past), 1)
    for name, x in (("fwd_factor_resid_30m", close.transform(lambda x: x.shift(-30) / x - 1)), ("step_factor_resid_p3", close.transform(lambda x: x.shift(-3) / x.shift(-2) - 1))):
        want = residuals(cube(x).loc[5:5].to_numpy(), v)
        have = got.pivot(index="minute", columns="security_id", values=name).to_numpy()
        assert np.isfinite(want).sum() >= 30
        np.testing.assert_allclose(have, want, atol=1e-9)


def test_factor_targets_query(spark):
    from tidemark import catalog
    from tidemark.plans import all_queries  # noqa: F401

    df = catalog.queries()["clock_factor_targets"](spark, "/root/testdata/sf0.01")
    assert len(df.columns) == 3 + 14 and df.where("fwd_factor_resid_1m IS NOT NULL AND step_factor_resid_p1 IS NOT NULL").count() > 100


def test_peer_block_has_every_listed_feature(spark, bars):
    from pyspark.sql import functions as F

    from tidemark.operators.factors import peer_block

    pack = Pack(SPARK, hist=3, beta_sessions=2, beta_least=20)
    grid = staged.apply(spark.createDataFrame(bars.query("session_no < 7")), pack.liquidity_stages())
    b = peer_block(grid, pack, 3, 1, 1).toPandas().sort_values(["security_id", "session_no", "minute"]).reset_index(drop=True)
    u = b.groupby(["security_id", "minute"])["factor_resid_1m"]
    want = sum(np.sign(b["factor_resid_1m"] - u.shift(k)) for k in (1, 2, 3)) / 3
    equal(b["factor_resid_tod_tail_1m"], want)
    # with one peer its weight is 1: the peer is known by its basket, +-u of another security
    wide = {c: b.pivot(index=["session_no", "minute"], columns="security_id", values=c) for c in b.columns[3:]}
    liquid = grid.select("session_no", "minute", "security_id", "liquidity_rank_20d").toPandas().pivot(index=["session_no", "minute"], columns="security_id", values="liquidity_rank_20d").reindex(wide["peer_gap_2m"].index)
    seen = 0
    for d in (5, 6):
        for i in range(3):
            get = lambda c, j=i, d=d: wide[c].loc[d][j].to_numpy()
            j, sign = next((j, s) for j in range(3) if j != i for s in (1, -1) if np.allclose(get("peer_basket_resid_1m")[1:], s * get("factor_resid_1m", j)[1:]))
            np.testing.assert_allclose(get("peer_gap_2m")[2:], (sign * get("factor_resid_2m", j) - get("factor_resid_2m"))[2:], atol=1e-12)
            np.testing.assert_allclose(get("leader_liquidity_advantage"), (liquid.loc[d][j] - liquid.loc[d][i]).to_numpy())
            shock = get("factor_resid_tod_tail_1m", j) * np.sign(get("peer_lead_pred_1m")) >= 0.98
            np.testing.assert_allclose(get("peer_shock_breadth_1m")[1:], shock[1:].astype(float))
            # the first minute has no return, so the residual before the second one is missing, and stays so
            assert np.isnan(get("peer_lead_pred_2m")[:2]).all() and np.isfinite(get("peer_lead_pred_2m")[2:]).all()
            seen += shock.sum()
    assert seen


def test_every_listed_surface(spark):
    from tidemark.operators import pairs

    found = pairs.surfaces()
    assert len({x[0] for x in found}) == len(found) == 6210 - 3 * 117  # all of the survey's but its single variables
    rng = np.random.default_rng(2)
    q = pd.DataFrame({f"q_{x}": rng.integers(0, 201, 150) / 200 for x in pairs.legs()})
    q[q.columns[::3]] = q[q.columns[::3]].mask(rng.random((150, len(q.columns[::3]))) < 0.2)
    q["y"], q["z"] = rng.normal(size=150), np.where(rng.random(150) < 0.3, np.nan, rng.normal(size=150))
    frame = spark.createDataFrame(q.astype(object).where(q.notna(), None), ", ".join(f"{c} double" for c in q.columns))
    got = {(r.surface, r.cell, r.target): (r.n, r.mean) for r in pairs.scan(frame, ["y", "z"]).collect()}
    want = {}
    for name, a, b, bins, lo, hi in found:
        x = q[f"q_{a}"]
        ok = x.notna() & (x >= lo if lo is not None else True) & (x <= hi if hi is not None else True)
        code = lambda v, bins=bins: np.minimum(np.floor(v * bins), bins - 1)
        cell = (code(x) * bins if lo is None and hi is None else 0 * x) + (code(q[f"q_{b}"]) if b else 0)
        ok &= cell.notna()
        for t in ("y", "z"):
            g = q.loc[ok & q[t].notna(), t].groupby(cell[ok].astype(int))
            want |= {(name, c, t): (int(n), m) for c, n, m in zip(g.count().index, g.count(), g.mean())}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
