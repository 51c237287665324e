"""Every registered query against its SQL on the smallest tables; what has no SQL against a plain computation."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark import catalog
from tidemark.plans import all_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def order(row):
    return tuple((x is None, "" if isinstance(x, (int, float)) else str(x), x if isinstance(x, (int, float)) else 0) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and y is not None and x == pytest.approx(y, rel=1e-6, abs=2e-5)


def events() -> pd.DataFrame:
    return pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])


def test_capital_capped(spark):
    got = {r.signal_id: r.admitted for r in QUERIES["capital_capped"](spark, SF).collect()}
    open_, want = [], {}
    for r in events().query("event_type == 'purchase'").itertuples():
        open_ = [t for t in open_ if t > r.ts]
        want[r.event_id] = len(open_) < 5
        if want[r.event_id]:
            open_.append(r.ts + pd.Timedelta(hours=3))
    assert got == want


def test_replay_one_position(spark):
    got = {r.signal_id: r.status for r in QUERIES["replay_one_position"](spark, SF).collect()}
    want = {}
    for _, g in events().groupby("user_id"):
        ts, ids, free = g["ts"].tolist(), g["event_id"].tolist(), None
        for k, (t, i) in enumerate(zip(ts, ids)):
            if k + 3 >= len(ts):
                want[i] = "no_exit"
            elif free is not None and t < free:
                want[i] = "position_open"
            else:
                want[i], free = "filled", ts[k + 3]
    assert got == want


def test_placebo_and_ridge(spark):
    p = QUERIES["placebo_test"](spark, SF).first()
    li = pd.read_parquet(f"{SF}/lineitem.parquet")
    assert 1 / 21 <= p.p <= 1 and p.effect == pytest.approx(((li.l_quantity > 25) * li.l_tax).mean())
    out = QUERIES["ridge_model"](spark, SF).collect()
    assert len(out) == 3 and sum(r.n for r in out) == len(li)


def test_out_of_fold_learns(spark):
    from tidemark.operators.learning import out_of_fold

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    rows = [(float(a), None if k % 50 == 0 else float(b), float(3 * a - b + 0.1 * e), k % 3) for k, ((a, b), e) in enumerate(zip(x, rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    assert all(r.corr > 0.9 for r in out_of_fold(df, ["a", "b"], "y", "fold").collect())


def test_factor_residuals():
    from tidemark.operators.factors import loadings, pairwise_covariance, residuals

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 1)) @ rng.normal(size=(1, 6)) + 0.01 * rng.normal(size=(200, 6))
    x[5, 2] = np.nan
    full = x[~np.isnan(x).any(axis=1)]
    assert np.allclose(pairwise_covariance(full), np.cov(full.T))
    u = residuals(x, loadings(pairwise_covariance(x), 1))
    assert np.nanstd(u) < 0.02 and np.isnan(u[5, 2]) and np.isfinite(u[5, 0])


def test_factor_block_is_prior_only(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.factors import factor_block

    rng = np.random.default_rng(5)
    rows = [(int(s), int(d), m, float(x), float(y)) for d in range(4) for m in range(12) for s, (x, y) in enumerate(rng.normal(size=(4, 2)))]
    g = spark.createDataFrame(rows, "security_id long, session_no int, minute int, r_1 double, r_2 double")
    key = ["session_no", "minute", "security_id"]
    a = factor_block(g, 3, 1, 2).where("session_no < 3").orderBy(*key).toPandas()
    b = factor_block(g.withColumn("r_1", F.when(F.col("session_no") == 3, F.col("r_1") * 9).otherwise(F.col("r_1"))), 3, 1, 2).where("session_no < 3").orderBy(*key).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 2 * 12 * 4
