"""Registry and selection rules: errors, odd rows, packs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry as G
from tidemark.operators import selection as S
from tidemark.operators.features import catalogue


def test_specs():
    specs = G.compile_specs(catalogue())
    assert len({x.feature_id for x in specs}) == len(specs) == len({x.definition for x in specs})
    assert not any(x.kind == "minutes" and not x.grid.startswith("intraday") or x.kind == "sessions" and x.grid.startswith("intraday") for x in specs)
    few = G.compile_specs(catalogue(), scales=["5m", "30m", "1d"], grids=["intraday_5m"])
    assert {x.scale for x in few} == {"5m", "30m", "5m_30m", "context"} and {x.grid for x in few} == {"intraday_5m"}
    with pytest.raises(ValueError, match="twice"):
        G.compile_specs([("returns", "simple_return")] * 2)
    with pytest.raises(ValueError, match="scale"):
        G.scale("0m")
    with pytest.raises(ValueError, match="twice"):
        G.target_ids({"intraday": ["1m", "1m"], "daily": []}, ["raw"])


def test_scope_refuses_unknown_names():
    specs = G.compile_specs(catalogue())
    for bad in ({"ids": ["nothing"]}, {"concepts": ["nothing"]}, {"concepts": ["simple_return"], "scale": ["3m"]}):
        with pytest.raises(ValueError):
            G.select(specs, **bad)
    assert {x.grid for x in G.select(specs, concepts=["simple_return"], grid=["daily_close"])} == {"daily_close"}


def test_contexts_and_variants():
    specs = G.compile_specs(catalogue())
    a, b = G.select(specs, ids=["simple_return__20d__raw__daily_close", "log_return__20d__raw__daily_close"])
    pairs = G.variant_pairs(specs, a, b)
    assert len(pairs) == 15 and all(x <= y for x, y in pairs) and (a.feature_id, b.feature_id) not in pairs
    made = G.with_contexts([("x", "y"), ("z",)], ["c", "d"])
    assert len({i for i, _ in made}) == 4 and made[0][1] == ("x", "y", "c")


def test_packs(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "open double, close double")
    G.implementation("mine", "gain")(lambda d: F.try_divide(d["close"], d["open"]) - 1)
    G.implementation("mine", "label")(lambda d: F.lit("x"))
    assert G.compute(df, "mine", ["gain"]).first().gain == 1.0
    with pytest.raises(TypeError, match="label"):
        G.compute(df, "mine", ["gain", "label"])
    with pytest.raises(ValueError, match="no"):
        G.compute(df, "mine", ["nothing"])
    with pytest.raises(ValueError, match="already"):
        G.implementation("mine", "gain")(lambda d: F.lit(0.0))
    pack = G.load_pack({"name": "loaded", "implementations": {"weekday": "tests.test_selection:weekday_of"}})
    assert set(pack) == {"weekday"} and G.compute(spark.sql("SELECT DATE'2026-11-26' AS d"), "loaded", ["weekday"]).first().weekday == 3.0
    with pytest.raises(ValueError, match="function"):
        G.load_pack({"name": "other", "implementations": {"x": "tests.test_selection:nothing"}})


def weekday_of(df):
    return F.weekday(df["d"]).cast("double")


def test_survivors_fall_back_to_the_best(spark):
    t = spark.createDataFrame([("a", 0.01, 1.0), ("a", 0.5, -9.0), ("b", 0.3, 2.0), ("c", 0.3, -3.0), ("d", None, 1.0)], "f string, p double, t double")
    assert [r.f for r in S.survivors(t, "f", "p", "t", 0.05, 3).orderBy("best_p", F.desc("best_statistic")).collect()] == ["a", "c", "b"]
    assert [r.f for r in S.survivors(t, "f", "p", "t", 0.3, 2).orderBy("best_p").collect()] == ["a", "c"]
    assert S.survivors(t.where("false"), "f", "p", "t", 0.05, 3).count() == 0


def test_roles(spark):
    rows = spark.createDataFrame([("f", 1, 5.0, None), ("f", 2, 5.0, 1.0), ("f", 3, 1.0, 0.5), ("g", 4, None, None), ("g", 5, 2.0, 2.0)], "family string, id int, x double, y double")
    won = {(r.family, r.id): r.roles for r in S.role_winners(rows, "family", "id", {"big": F.col("x"), "late": F.col("y")}, [], 2).collect()}
    assert won == {("f", 1): "big", ("f", 2): "late", ("g", 5): "big|late"}
    assert S.role_winners(rows, "family", "id", {"big": F.col("x"), "late": F.col("y")}, [], 1).count() == 2


def test_conditions_and_tails(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,), (9.0,)], "x double")
    label = lambda **k: [r[0] for r in df.select(S.condition(F.col("x"), [2.0, 5.0], ["low", "mid", "high"], **k)).collect()]
    assert label() == [None, None, "low", "mid", "high"] and label(missing="category")[:2] == ["missing", "missing"]
    for cuts, labels in (([2.0], ["a"]), ([3.0, 2.0], ["a", "b", "c"])):
        with pytest.raises(ValueError):
            S.condition(F.col("x"), cuts, labels)
    assert S.tail_mask([(F.col("x"), F.col("x"), 1), (F.col("x"), F.col("x"), 2)], 5, 0.1) is None
    with pytest.raises(ValueError):
        S.tail_mask([(F.col("x"), F.col("x"), 0)], 5, 0.6)
    with pytest.raises(ValueError):
        S.cell_union(df, "x", [1, 1], 3, "x")


def test_weekdays(spark):
    import numpy as np

    days = np.arange("1968-01-01", "1968-03-01", dtype="datetime64[D]")
    rows = [(str(a), str(b)) for a in days[:16] for b in days]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(S.weekdays(F.to_date("a"), F.to_date("b"))).collect()]
    assert got == [int(np.busday_count(a, b)) if a <= b else -int(np.busday_count(b, a)) for a, b in rows]


def test_ols_on_collinear_columns(spark):
    df = spark.createDataFrame([(float(k), float(2 * k), 3.0 * k + 1) for k in range(20)] + [(None, 1.0, 5.0)], "a double, b double, y double")
    c = {r.term: r.coefficient for r in S.ols(df, "y", ["a", "b"]).collect()}
    assert c["intercept"] == pytest.approx(1) and c["a"] + 2 * c["b"] == pytest.approx(3)


def test_service_verbs(spark, tmp_path):
    from tidemark.operators import service

    df = spark.createDataFrame([(c, float(c + k)) for c in range(9) for k in range(3)], "cell int, y double")
    d = service.describe({"cells": df, "few": df.limit(2)})
    assert {r.table: r.rows for r in d.collect()} == {"cells": 27, "few": 2}
    key = service.freeze(df, str(tmp_path), "candidates", {"v": 1})
    assert service.freeze(df.repartition(3), str(tmp_path), "candidates", {"v": 1}) == key
    for changed, spec in ((df.limit(5), {"v": 1}), (df, {"v": 2})):
        with pytest.raises(PermissionError, match="frozen"):
            service.freeze(changed, str(tmp_path), "candidates", spec)
    near = {r.cell: (r.n, r.mean, r.selected) for r in service.experiment("neighbour", df, {"resolution": 3, "cell": 1}).collect()}
    assert near == {c: (3, c + 1.0, c == 1) for c in range(6)}
    with pytest.raises(ValueError):
        service.experiment("other", df, {})


def test_autopsy_of_an_effect_of_one_security(spark):
    from tidemark.operators.dossier import autopsy

    rows = [(s, m, 5.0 if s == 0 else -0.01) for s in range(10) for m in range(20)]
    df = spark.createDataFrame(rows, "s int, m int, y double")
    got = {r.check: r.passed for r in autopsy(df, "y", "s", "m", F.col("m") < 10, 0.001).collect()}
    assert got["rows"] and got["mean"] and got["halves"] and got["months"] and not got["without_best_security"] and got["without_best_month"]
    assert not any(r.passed for r in autopsy(df.where("false"), "y", "s", "m", F.col("m") < 10, 0.001).collect())
