"""Operators that must hold for odd rows and hot keys: as-of joins in buckets, windows of quotes, targets across actions, sinks, placebo runs, averages."""

from __future__ import annotations

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import columns as C
from tidemark.operators import forensics, joins, panel
from tidemark.operators.features import ema
from tidemark.functions.sqltext import SPARK
from tidemark.sources import readers, sinks


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_in_buckets_equals_asof(spark, strict, forward):
    rnd = random.Random(1)
    left = spark.createDataFrame([(k, rnd.choice(["hot", "hot", "b", None]), rnd.randrange(500)) for k in range(300)], "id long, k string, t long")
    right = spark.createDataFrame([(rnd.choice(["hot", "b", None]), t, t) for t in rnd.sample(range(500), 60)], "k string, at long, v long")
    key = lambda df: sorted((r.id, r.v if r.v is not None else -1) for r in df.collect())
    whole = joins.asof(left, right, ["k"], "t", "at", ["v"], strict=strict, forward=forward)
    cut = joins.asof(left, right, ["k"], "t", "at", ["v"], strict=strict, forward=forward, bucket=lambda t: F.floor(t / 37))
    assert key(cut) == key(whole) and cut.columns == whole.columns


def test_quote_window_takes_each_quote_once(spark):
    rnd = random.Random(2)
    req = [(rnd.choice("ab"), lo, lo + rnd.randrange(1, 90)) for lo in (rnd.randrange(900) for _ in range(40))]
    quotes = [(rnd.choice("abc"), rnd.randrange(1000), k % 50) for k in range(500)] * 2
    cov = [("a", 0, 2000), ("b", 0, 600)]
    ok = [(s, lo, hi) for s, lo, hi in req if any(s == c and lo >= f and hi <= t for c, f, t in cov)]
    want = sorted(q for q in quotes if any(q[0] == s and lo <= q[1] < hi for s, lo, hi in ok))
    got = readers.quote_window(spark.createDataFrame(quotes, "s string, quote_ts long, n long"), spark.createDataFrame(req, "s string, lo long, hi long"), spark.createDataFrame(cov, "s string, from_ts long, to_ts long"), ["s"], 50.0)
    assert sorted(map(tuple, got.collect())) == want and want


def test_fail_closed_keeps_repeated_rows(spark):
    t = spark.createDataFrame([("a", 1, 5, 0.5)] * 3 + [("a", 5, 9, 0.1), ("b", 1, 9, 0.2), ("a", None, 9, 0.3)], "s string, entry int, exit int, y double")
    actions = spark.createDataFrame([("a", 5), ("a", 5), ("a", None), ("c", 3)], "s string, action_date int")
    got = sorted((r.s, r.entry or 0, r.crosses_action, r.y) if r.y is not None else (r.s, r.entry or 0, r.crosses_action) for r in panel.fail_closed(t, actions, "s", "entry", "exit", "y").collect())
    assert got == sorted([("a", 1, True)] * 3 + [("a", 5, False, 0.1), ("b", 1, False, 0.2), ("a", 0, False, 0.3)])


def test_sink_swaps_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(4):
        before = readers.current(spark, path)
        old = spark.read.parquet(before) if k else None
        sinks.write_atomic(spark.range(k + 1), path)
        assert readers.lake(spark, path).count() == k + 1
        assert old is None or old.count() == k  # a reader that had begun still reads its version
    assert sum(x.name.startswith("version-") for x in (tmp_path / "t").iterdir()) == 2


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_atomic(spark.range(3), path)
    with pytest.raises(Exception):
        sinks.write_atomic(spark.range(3).select(F.raise_error(F.lit("lost")).alias("id")), path)
    assert readers.lake(spark, path).count() == 3


def test_placebo(spark):
    rng = np.random.default_rng(3)
    rows = [(d, k, int(k % 3 == 0), float(rng.normal() + 2.0 * (k % 3 == 0)), float(rng.normal())) for d in range(30) for k in range(30)]
    df = spark.createDataFrame(rows, "d int, k int, s int, planted double, nothing double")
    planted, nothing = (forensics.placebo(df, "d", ["d", "k"], "s", y, 40).first() for y in ("planted", "nothing"))
    assert planted.p == pytest.approx(1 / 41) and nothing.p > 0.1
    assert planted.effect == pytest.approx(np.mean([r[2] * r[3] for r in rows]))
    # the runs draw as many rows of each decision as it has signals, by the hash
    h = {(r.d, r.k): [r[f"h{j}"] for j in range(3)] for r in df.select("d", "k", *(F.xxhash64(F.lit(0), F.lit(j), F.struct("d", "k")).alias(f"h{j}") for j in range(3))).collect()}
    real, far = sum(r[2] * r[4] for r in rows), 0
    for j in range(3):
        total = sum(r[4] for d in range(30) for r in sorted((r for r in rows if r[0] == d), key=lambda r: h[r[0], r[1]][j])[:10])
        far += abs(total) >= abs(real)
    assert forensics.placebo(df, "d", ["d", "k"], "s", "nothing", 3).first().p == pytest.approx((1 + far) / 4)


def test_spearman(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 200).astype(float), "b": rng.normal(size=200)})
    pdf["b"] += pdf["a"]
    got = forensics.spearman(spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0)], "a double, b double")), "a", "b").first()
    assert got.n == 200 and got.rho == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))


@pytest.mark.parametrize("span", [1, 3, 50, 200])
def test_ema_is_exact(spark, span):
    rng = np.random.default_rng(5)
    x = 100 + np.cumsum(rng.normal(size=600))
    x[300] = 1e6  # an old extreme still weighs
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "security_id long, session_date int, close double")
    got = [r.e for r in df.selectExpr("session_date", f"{ema(SPARK, 'close', span)} AS e").orderBy("session_date").collect()]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=span, adjust=False).mean(), rtol=1e-11)


def test_sum_before_with_many_ranges(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 300, 2000)
    df = spark.createDataFrame([(k, float(x), float(k % 7)) for k, x in enumerate(v)], "id long, x double, a double")
    got = {r.id: r.before for r in C.sum_before(df, "x", F.col("a"), ["id"], rows=10).collect()}
    order = sorted(range(2000), key=lambda k: (v[k], k))
    total, want = 0.0, {}
    for k in order:
        want[k], total = total, total + k % 7
    assert got == want


def test_artefacts_are_validated(spark, tmp_path):
    import glob

    made = []
    key = sinks.stage_key("a")
    for _ in range(2):
        sinks.artefact(spark, str(tmp_path), key, lambda: made.append(1) or spark.range(50).repartition(3))
    assert len(made) == 1 and sinks.validate(spark, str(tmp_path), key).count() == 0
    path = glob.glob(f"{tmp_path}/{key}/part-*.parquet")[0]
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))  # the local file system's own checksum
    open(path, "ab").write(b"x")
    assert sinks.validate(spark, str(tmp_path), key).count() == 1


def test_ewma_formula(spark):
    from tidemark.operators.learning import compile_formula

    x = np.random.default_rng(7).normal(size=80)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "s string, d int, x double")
    f = {"op": "ewma", "args": [{"feature": "x"}, 9]}
    got = [r.f for r in df.select("d", compile_formula(f, "d", "s", "d").alias("f")).orderBy("d").collect()]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=9, adjust=False).mean(), rtol=1e-12)
