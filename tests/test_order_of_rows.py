"""Queries whose SQL leaves something to the order of the rows, on tables read by many tasks, against the SQL read by one thread."""

from __future__ import annotations

import duckdb
import pytest

from tests.test_queries import QUERIES, SF, SQL, order, plain


@pytest.fixture
def many_tasks(spark):
    """Small splits: each row group is a task of its own."""
    held = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def both(spark, folder, table, rows, name):
    """The query's rows and those of its SQL, over a table of `rows` in row groups of 2,048."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet' (ROW_GROUP_SIZE 2048)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    assert spark.read.parquet(f"{folder}/{table}.parquet").rdd.getNumPartitions() > 4
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=order)
    return got, want


@pytest.mark.parametrize("key", ["l_orderkey + k * 1500", "hash(l_orderkey, k) % 1000000", "CASE WHEN k % 2 = 1 THEN l_orderkey + k * 1500 END"])
def test_dearest_of_equal_prices(many_tasks, tmp_path, key):
    rows = f"SELECT l.* REPLACE (CAST({key} AS BIGINT) AS l_orderkey) FROM '{SF}/lineitem.parquet' l, range(6) t(k) ORDER BY k, l_shipdate, l_extendedprice, l_orderkey"
    got, want = both(many_tasks, tmp_path, "lineitem", rows, "filtered_aggregates")
    assert len(got) == len(want) == 6
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-6, abs=2e-5)


@pytest.mark.parametrize("value, user, by", [("value", "user_id", "k, ts"), ("value", "user_id", "hash(event_id, k)"), ("0.1e0 * (1 + event_id % 5)", "user_id % 9", "event_id, k"), ("CASE WHEN event_id % 7 > 0 THEN 29.27e0 END", "user_id + k // 8 * 150", "hash(k, event_id)")])
def test_close_at_the_mean(many_tasks, tmp_path, value, user, by):
    """Closes that are the mean but for rounding, so that the order of the additions decides the state; with unknown values too."""
    rows = f"SELECT e.* REPLACE (event_id + k * 1000 AS event_id, {user} AS user_id, {value} AS value) FROM '{SF}/events.parquet' e, range(24) t(k) ORDER BY {by}"
    got, want = both(many_tasks, tmp_path, "events", rows, "state_lifecycle")
    assert got == want
