"""Driver-side steps on reduced tables, and the job ledger."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators.jobs import Jobs, run_one
from tidemark.operators.portfolio import batches, combination_weights, linkage_clusters, plateaus, positions, resolved, tagged_union


def test_plateaus():
    e = np.array([[1.0, 1.2, 0.1], [-1.0, 0.9, 0.0], [-1.1, 0.2, 2.0]])
    assert plateaus(e, 0.8) == [[(0, 0), (0, 1), (1, 1)], [(1, 0), (2, 0)], [(2, 2)]]
    assert plateaus(np.zeros((2, 2)), 0.5) == []


def test_clusters_and_weights():
    c = np.array([[1, 0.9, 0.1, 0], [0.9, 1, 0.2, 0], [0.1, 0.2, 1, -0.8], [0, 0, -0.8, 1]])
    assert linkage_clusters(c) == [0, 0, 1, 1]
    w = combination_weights(np.eye(4), np.array([5.0, 1.0, 1.0, -2.0]))
    assert w.sum() == pytest.approx(1) and w.max() <= 0.35 + 1e-9 and w[3] == 0
    assert combination_weights(np.eye(2), np.array([-1.0, -1.0])).sum() == 0


def test_batches_keep_orientation():
    got = batches([("b", "a", ("t1",)), ("c", "a", ("t1",)), ("d", "a", ("t2", "t1")), ("e", "a", ("t1",))], 2)
    assert got == [(("t1",), [("b", "a"), ("c", "a")]), (("t1",), [("e", "a")]), (("t1", "t2"), [("d", "a")])]


def test_requests_positions_union(spark):
    canon = spark.createDataFrame([("a", "b", 1)], "first_id string, second_id string, n int")
    ask = lambda *p: spark.createDataFrame([p], "first_id string, second_id string")
    assert resolved(ask("a", "b"), canon).first().n == 1
    for pair, why in ((("b", "a"), "reversed"), (("x", "y"), "unknown")):
        with pytest.raises(ValueError, match=why):
            resolved(ask(*pair), canon)
    s = spark.createDataFrame([(1, float(k)) for k in range(10)] + [(1, None)], "d int, s double")
    out = positions(s.where("s IS NOT NULL"), "d", "s", 0.2).collect()
    assert sum(r.position for r in out) == pytest.approx(0) and sum(abs(r.position) for r in out) == pytest.approx(1)
    one = spark.range(2)
    assert tagged_union({3: one, 5: one}, 4).where("resolution = 5").count() == 2
    with pytest.raises(ValueError, match="expected"):
        tagged_union({3: one}, 3)


def test_jobs():
    j = Jobs()
    a, b = j.submit("ok", {"x": 1}), j.submit("bad", {})
    assert run_one(j, {"ok": lambda r: r["x"]}) == a and j.state(a) == "done"
    assert run_one(j, {}) == b and j.state(b) == "failed" and j.retry(b) and j.cancel(b)
    assert run_one(j, {}) is None and j.history(b) == ["submitted", "claimed", "failed", "retried", "cancelled"]
