"""Sources, sinks, service, streaming and column rules."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import columns as C
from tidemark.operators import features
from tidemark.operators.learning import compile_formula
from tidemark.operators.service import Query, advance, cursor, position, reconcile, search
from tidemark.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_gate_refuses_sealed_periods():
    with pytest.raises(PermissionError):
        readers.Gate({"discovery": ("2020-01-01", "2020-02-01")}).predicate("holdout", "ts")
    assert advance("BUILD_ONLY", "DISCOVERY") == "DISCOVERY"
    with pytest.raises(PermissionError):
        advance("BUILD_ONLY", "HOLDOUT")


def test_gated_read_prunes(spark):
    gate = readers.Gate({"d": ("1996-01-01", "1996-12-31")})
    df = readers.gated(spark.read.parquet(f"{SF}/orders.parquet"), gate, "d", "o_orderdate", ["o_orderkey"])
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "o_comment" not in plan and df.columns == ["o_orderkey"]
    with pytest.raises(ValueError, match="missing"):
        readers.require_columns(df, ["nothing"])


def test_fingerprint_is_order_free(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    assert readers.fingerprint(df) == readers.fingerprint(df.repartition(3).orderBy(F.desc("n_name")))
    assert readers.fingerprint(df) != readers.fingerprint(df.limit(5))


def test_sinks_round_trip(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    for _ in range(2):
        sinks.write_atomic(df, f"{tmp_path}/n", "n_regionkey")
    assert readers.lake(spark, f"{tmp_path}/n", n_regionkey=1).count() == df.where("n_regionkey = 1").count()
    sinks.views(spark, {"my_nations": f"{tmp_path}/n"})
    assert spark.table("my_nations").count() == df.count()
    key = sinks.stage_key({"a": 1}, "v1")
    made = []
    for _ in range(2):
        out = sinks.artefact(spark, str(tmp_path), key, lambda: made.append(1) or df)
    assert out.count() == df.count() and len(made) == 1
    assert sinks.manifest(out).count() >= 1
    with pytest.raises(ValueError, match="one candidate"):
        sinks.export_signals(df.withColumn("candidate_key", F.col("n_name")), f"{tmp_path}/x", ["n_name"])


def test_coverage_is_all_or_nothing(spark):
    cov = spark.createDataFrame([("a", 0, 10), ("a", 20, 30)], "s string, from_ts long, to_ts long")
    req = spark.createDataFrame([("a", 2, 9), ("a", 8, 22), ("b", 1, 2)], "s string, lo long, hi long")
    assert [tuple(r) for r in readers.covered(req, cov, ["s"]).collect()] == [("a", 2, 9)]
    q = spark.createDataFrame([("a", 3), ("a", 9), ("a", 21)], "s string, quote_ts long")
    assert sorted(r.quote_ts for r in readers.quote_window(q, req, cov, ["s"]).collect()) == [3]


def test_packing_round_trip(spark):
    df = spark.range(1, 101).select((F.col("id") / 100).alias("r")).unionByName(spark.sql("SELECT CAST(NULL AS DOUBLE) AS r"))
    p = df.select("r", C.packed(F.col("r")).alias("p"))
    bad = p.select(*(C.unpacked(F.col("p"), k).eqNullSafe(C.rank_bin(F.col("r"), k)).alias(str(k)) for k in (3, 5, 10))).where("NOT (`3` AND `5` AND `10`)")
    assert bad.isEmpty() and p.agg(F.max("p")).first()[0] == 255
    assert p.where("p < 255").select("p").distinct().count() == 12


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(C.finite(F.col("x"))).collect()] == [1.0, None, None, None]
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,), (0.5,)], "p double")
    q = {r.p: r.q_value for r in C.benjamini_hochberg(p, "p").collect()}
    assert q[0.01] == pytest.approx(0.04) and q[0.03] == pytest.approx(0.16 / 3) and q[0.04] == pytest.approx(0.16 / 3) and q[0.5] == 0.5 and q[None] is None
    assert C.benjamini_hochberg(p, "p", invalid_as_one=True).where("q_value = 1").count() >= 1


def test_normal_tail(spark):
    import math

    z = [0.0, 0.5, 1.0, 1.96, 3.0, -2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(C.normal_two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], abs=2e-7)


def test_formulas(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0), (2, "b", 2.0)], "d int, s string, x double")
    f = {"op": "subtract", "args": [{"op": "rank", "args": [{"feature": "x"}]}, {"op": "zscore", "args": [{"feature": "x"}]}]}
    got = {(r.d, r.s): r.f for r in df.select("d", "s", compile_formula(f, "d", "s", "d").alias("f")).collect()}
    assert got[1, "a"] == pytest.approx(0.5 + 1) and got[1, "b"] == pytest.approx(1 - 1) and got[2, "a"] is None
    deep = {"op": "abs", "args": [{"op": "abs", "args": [{"op": "abs", "args": [{"op": "abs", "args": [{"feature": "x"}]}]}]}]}
    with pytest.raises(ValueError, match="three"):
        compile_formula(deep, "d", "s", "d")


def test_catalogue_is_complete():
    found = features.catalogue()
    assert len(found) == len(set(found)) >= 230 and len({f for f, _ in found}) == 17


def test_features_do_not_see_the_future(spark):
    from tidemark.plans import staged
    from tidemark.sources import tables

    bars = tables.bars(spark, SF).where("security_id < 6").cache()
    last = bars.agg(F.max("session_date")).first()[0]
    changed = bars.withColumns({c: F.when(F.col("session_date") == F.lit(last), F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    for family in ("returns", "path", "serial", "volatility"):
        out = [staged.run(b, lambda q, f=family: features.stages(f, q), ["security_id", "session_date"], features.concepts(family)).where(F.col("session_date") < F.lit(last)).orderBy("security_id", "session_date").toPandas() for b in (bars, changed)]
        pd.testing.assert_frame_equal(*out)


def test_service(spark):
    q = Query(bins=5, where={"t": ["x"]})
    assert position(q, cursor(q, 7)) == 7
    with pytest.raises(ValueError, match="another"):
        position(Query(bins=3), cursor(q, 7))
    s = spark.createDataFrame([("a", 10, 0.5), ("b", 1, -9.0), ("c", 10, -0.5), ("d", 10, 0.1)], "pair_id string, n long, mean double")
    assert [r.pair_id for r in search(s, 2, 5).collect()] == ["a", "c"]
    want, have = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("1", "done")], "k string, status string")
    with pytest.raises(ValueError, match="without a status"):
        reconcile(want, have, "k")
    assert reconcile(want.limit(1), have, "k").first().trials == 1


def test_streams_equal_batch(spark, tmp_path):
    from tidemark.streaming.windows import prior_means, tumbling

    e = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = tumbling(stream, "6 hours").writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.window.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("windows_out")) == key(tumbling(e, "6 hours"))
    q = prior_means(stream, 5).writeStream.outputMode("append").format("memory").queryName("means_out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.event_id: r.prior_mean for r in spark.table("means_out").collect()}
    pdf = e.toPandas().sort_values(["ts", "event_id"])
    want = pdf.groupby("user_id")["value"].transform(lambda v: v.shift().rolling(5, min_periods=1).mean())
    assert len(out) == len(pdf)
    assert all(pd.isna(w) if out[i] is None else out[i] == pytest.approx(w) for i, w in zip(pdf["event_id"], want))


def test_pair_plan():
    from tidemark.operators.pairs import plan, tails

    p = plan()
    assert len(p) == 305 and p[0] == ("resid_tod_tail_1m", "body_share_1m") and p[304] == ("liquidity_rank_20d", "dollar_per_trade_tod_tail_1m")
    assert len(tails()) == 72
