"""Tables in the shared folder: scopes delete what nobody reads any more, and a cluster without a shared folder is refused."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, near_dedup, topk


def folders(spark):
    top = common.shared_dir(spark).removeprefix("file://") + "/tidemark"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scope_keeps_what_it_is_told(spark):
    before = folders(spark)
    with common.scratch(spark):
        with common.scratch(spark) as kept:
            a, b = common.written(spark, spark.range(3), "a"), common.written(spark, spark.range(4), "b")
            kept(a)
        assert a.count() == 3 and not os.path.exists(b.scratch_path.removeprefix("file://"))
        assert len(folders(spark) - before) == 1
    assert folders(spark) == before
    with pytest.raises(ValueError), common.scratch(spark):
        common.written(spark, spark.range(3), "a")
        raise ValueError
    assert folders(spark) == before


def test_near_duplicates_leave_what_their_result_reads(spark, docs):
    before = folders(spark)
    out = near_dedup.near_duplicates(docs, 3, 85)
    assert len(folders(spark) - before) == 3
    assert out.count() == docs.count()


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(type("Session", (), {"sparkContext": Context()})())


def test_waves_cover_every_shard():
    for n in (1, 2, 3, 7, 8, 100):
        w = topk.waves(n)
        assert [k for a, b in w for k in range(a, b + 1)] == list(range(n))


def test_waves_share_the_kth_score(spark):
    """Many shards, ties, and a query's own rows: equal to all inner products."""
    import random

    rnd = random.Random(1)
    rows = [(k, [rnd.randrange(-3, 4) / 4 for _ in range(4)]) for k in range(400)] + [(20, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old, topk.SHARD = topk.SHARD, 30
    try:
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    finally:
        topk.SHARD = old
    want = []
    import math

    q = lambda v: [math.floor(64 * x) for x in v]
    for i, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(q(v), q(c))), j) for j, c in rows if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_large_components(spark):
    """Scores beyond a double's digits are exact, those beyond a long are clipped, components without exact values take no part."""
    big = float(2**40)
    rows = [(0, [big, 1.0]), (1, [big, 1 / 64]), (2, [-big, 0.0]), (3, [2.0**47, 0.0]), (4, [1.0, 1.0]), (5, [float(2**20), 3.0]), (6, [float(2**20), 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    one = 64 * 2**40
    assert got == [(1, 2**62 - 1), (5, min(one * 64 * 2**20 + 64 * 192, 2**62 - 1)), (6, min(one * 64 * 2**20 + 64 * 128, 2**62 - 1)), (4, one * 64 + 64 * 64), (2, -(2**62) + 1)]
    small = spark.createDataFrame([(0, [float(2**20), 1.0]), (1, [float(2**20), 1 / 64]), (2, [float(2**20), 2 / 64])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.top_k(small, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(2, 2**52 + 128), (1, 2**52 + 64)]


def test_workers_keep_what_is_used():
    import weakref

    class Table:
        def __init__(self):
            self.memo = {"me": self}  # a cycle, as the codecs have

    class Rows:
        def __init__(self, uses):
            self.uses = uses

        def __call__(self):
            if self.uses:
                common.once(("table", self.uses), Table)
            return lambda *row: None

    import pyarrow as pa

    schema = pa.schema([("x", pa.int64())])
    held = weakref.ref(common.once(("table", 1), Table))
    assert held() is not None
    list(common._RowMapper(Rows(1), schema)(iter([])))
    assert held() is not None  # the same key: kept from task to task
    other = weakref.ref(common.once(("table", 2), Table))
    assert held() is None and other() is not None
    list(common._RowMapper(Rows(None), schema)(iter([])))
    assert other() is None  # a task that uses none frees it
