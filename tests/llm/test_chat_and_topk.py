from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, topk

SF = "/root/testdata/sf0.001"


def sql(query, **views):
    con = duckdb.connect()
    for name, path in views.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.sql(query)


def test_chat_equals_sql(spark):
    df = chat.op3_chat_format(spark, SF)
    want = sql(f"SELECT {', '.join(df.columns)} FROM ({chat.SQL_OP3})", conversations=f"{SF}/conversations.parquet").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "<turn>user\n", "</turn>\n", "\\l\\s\\n<", "a\nb\\\\<<", "é漢😀</turn>"]
    data = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in odd for r in ("user", "assistant", None, "we\nird<\\n"))] + [(None, 0, "assistant", "x"), (2, None, "user", "y"), (2, None, "user", "y")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("opened", F.lit("clash"))
    out = chat.render(chat.fold(chat.events_of_turns(rows)))
    got = {r.conv_id: (r.turns, r.loss) for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("spans")).alias("loss")).collect()}
    want = [(r or "", t or "") for _, _, r, t in data[:-3]]
    assert [tuple(t) for t in got[1][0]] == want
    assert got[1][1] == [t for r, t in want if r == "assistant"]
    assert [tuple(t) for t in got[None][0]] == [("assistant", "x")] and len(got[2][0]) == 2
    assert chat.render(chat.fold(chat.events_of_turns(rows.where("false")))).count() == 0


def test_events_fold(spark):
    e = [
        (1, "message", 1, "user", "hi"), (2, "message", 2, "assistant", "a"), (3, "delta", 2, None, "b"), (4, "edit", 2, None, "X"), (5, "delta", 2, None, "y"), (6, "message", 3, "user", "q"),
        (7, "regenerate", 2, None, None), (8, "delta", 2, None, "new"), (9, "message", 4, "user", "after"), (10, "edit", 1, None, "hello"),
    ]
    df = spark.createDataFrame([(1, *x) for x in e], "conv_id long, seq long, kind string, message long, role string, text string")
    assert [(r.role, r.text) for r in chat.fold(df).orderBy("opened").collect()] == [("user", "hello"), ("assistant", "new"), ("user", "after")]


@pytest.mark.parametrize("shard", [60, 100_000])
def test_topk_equals_sql(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    got = topk.op2_exact_topk(spark, SF)
    want = sql(f"SELECT {', '.join(got.columns)} FROM ({topk.SQL_OP2})", embeddings=f"{SF}/embeddings.parquet").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (7, [-3.0, -0.01])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("q", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    assert got == [(0, 1, 1, 64 * 64 * 5), (0, 2, 20, 64 * 32 * 3), (0, 3, 20, 64 * 32 * 3), (20, 1, 0, 64 * 32 * 3), (20, 2, 1, 64 * 32 * 3), (20, 3, 7, 32 * (-192 - 1))]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
