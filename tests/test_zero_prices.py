"""Queries that divide by prices, on events of which many have a price of zero, against their SQL."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.test_queries import QUERIES, SF, SQL, TABLES, order, plain

DIVIDING = [
    "bar_rollup", "contribution_concentration", "cost_capacity_curves", "distribution_stats", "drawdown_curve", "effect_decay", "event_path", "excursions", "features_path", "features_returns", "features_session", "grouped_effects", "leave_out_views", "offset_self_join", "running_and_top_share",
    "same_bucket_features", "session_history", "session_metrics", "specific_return", "target_ledger_pivot", "targets_adjusted", "targets_eod_overnight", "targets_fail_closed", "targets_forward", "trade_summary",
]


@pytest.fixture(scope="module")
def zero(tmp_path_factory):
    """The smallest tables, with every fourth price zero and all prices of one user."""
    folder = str(tmp_path_factory.mktemp("zero"))
    con = duckdb.connect()
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 4 = 0 OR user_id = 3 THEN 0e0 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", DIVIDING)
def test_division_by_zero_is_null(spark, zero, name):
    folder, con = zero
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-6, abs=2e-5)
