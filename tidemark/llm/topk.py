"""Exact top-k inner-product search by ball trees.

Vectors are cut into shards by a hash of their id; each shard builds a ball tree. Queries go through the shards in
blocks. Within a shard, nodes are visited in the order of their inner-product upper bound (centre score plus query
norm times radius), and a node is skipped for every query whose current kth score its bound does not reach. The kth
scores are shared across shards: shards are searched in waves of 1, 2, 4, .. of them, and each wave starts from the kth
best scores of all waves before it. (Shards are random samples of the vectors, so their root bounds are alike and would
skip none.)

Defined results: vectors that are null, or hold null or non-finite components, take no part; a query meets only vectors
of its own dimension; rows with the same id are separate candidates of a query, but never candidates of a query with
that id, and a repeated query row is one query for each distinct vector; ties go to the smaller id; an empty table
gives no rows; other columns are never read. Components of 2 ** 52 or more after quantising are no exact numbers and count
as non-finite; scores are exact integers, and those of 2 ** 62 or more are clipped to 2 ** 62 - 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, ship, written

#: Vectors of a shard, queries of a block, blocks that one task takes, vectors of a leaf.
SHARD, QUERIES, BLOCKS, LEAF = 8192, 512, 8, 128
#: Below every score.
LOW = -(1 << 62)


def quantised(vec: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null where the vector is null or holds a null or non-finite component."""
    x = vec.cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= 2.0**52))
    return F.when(~bad, F.transform(x, lambda c: F.floor(scale * c)))


class BallTree:
    """Centres and radii over rows of a matrix, split at the median of the widest direction."""

    def __init__(self, m: np.ndarray):
        self.order = np.arange(len(m))
        self.lo, self.hi, self.kids, self.centre, self.radius = [], [], [], [], []
        self.build(m.astype(np.float64), 0, len(m))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def build(self, m: np.ndarray, lo: int, hi: int) -> int:
        node, part = len(self.lo), m[self.order[lo:hi]]
        centre = part.mean(axis=0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(None)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())))
        if hi - lo > LEAF and self.radius[-1] > 0:
            far = part[((part - centre) ** 2).sum(axis=1).argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part @ (other - far), mid)]
            self.kids[node] = (self.build(m, lo, lo + mid), self.build(m, lo + mid, hi))
        return node


def search(tree: BallTree, m: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of each query that reach its kth score so far; missing ones have id -1 at the lowest score."""
    low = LOW
    best, who = np.full((len(q), k), low), np.full((len(q), k), -1, np.int64)
    most = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * max(m.shape[1], 1)
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    mf, qf = m.astype(kind), q.astype(kind)
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    bounds = q.astype(np.float64) @ tree.centre.T + norm[:, None] * tree.radius[None, :]
    bounds += 1e-9 * (1 + np.abs(bounds)) + 1e-6
    queue = [(-float(bounds[:, 0].max()), 0)]
    while queue:
        _, node = heapq.heappop(queue)
        live = np.flatnonzero(bounds[:, node] >= np.maximum(kth, best[:, -1]))
        if not len(live):
            continue
        if tree.kids[node]:
            for kid in tree.kids[node]:
                heapq.heappush(queue, (-float(bounds[live, kid].max()), kid))
            continue
        rows = tree.order[tree.lo[node] : tree.hi[node]]
        got = qf[live] @ mf[rows].T
        if kind is object:
            got = np.clip(got, low + 1, -low - 1)
        got = got.astype(np.int64)
        got[q_ids[live][:, None] == ids[rows][None, :]] = low
        scores, names = np.concatenate([best[live], got], axis=1), np.concatenate([who[live], np.broadcast_to(ids[rows], got.shape)], axis=1)
        names = np.where(scores == low, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -scores), axis=1)[:, :k]
        best[live], who[live] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
    who[best == low] = -1
    return best, who


def _search_shard(k: int):
    def f(vectors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(blocks):
            n = int(vectors["dim"].iloc[0])
            m = np.array(vectors["v"].tolist(), np.int64).reshape(len(vectors), n)
            ids = vectors["vec_id"].to_numpy(np.int64)
            tree = BallTree(m)
            for _, part in blocks.groupby("block"):
                q = np.array(part["v"].tolist(), np.int64).reshape(len(part), n)
                best, who = search(tree, m, ids, q, part["vec_id"].to_numpy(np.int64), part["kth"].to_numpy(np.int64), k)
                keep = best > LOW
                out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), k).reshape(-1, k)[keep], "query_id": np.repeat(part["vec_id"].to_numpy(), k).reshape(-1, k)[keep], "vec_id": who[keep], "score": best[keep]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("q", "query_id", "vec_id", "score")})

    return f


def top_k(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product (over quantised components) of each row for which query holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col)).alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = written(spark, rows.where("v is not null and vec_id is not null").withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    low = LOW
    schema = "q long, query_id long, vec_id long, score long"
    found = None
    for dim, n in sorted(sizes.items()):
        own = rows.where(F.col("dim") == dim)
        asks = own.where("asks").groupBy("vec_id", "v").agg(F.min("row").alias("q"))
        shards = max(1, -(-n // SHARD))
        tasks = max(1, -(-n // (20 * QUERIES * BLOCKS)))
        asks = written(spark, asks.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(tasks * BLOCKS)).cast("int")).withColumn("part", (F.col("block") / BLOCKS).cast("int")), "queries")
        own = own.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", "row"), F.lit(shards)).cast("int").alias("shard"))

        def over(first: int, last: int, asks: DataFrame) -> DataFrame:
            """Candidates from shards first to last: each shard meets the queries in groups of BLOCKS blocks."""
            v = own.where(F.col("shard").between(first, last)).select("vec_id", "v", "dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))
            q = asks.select("q", "vec_id", "v", "block", "kth", "part", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"))
            return v.groupBy("shard", "part").cogroup(q.groupBy("shard", "part")).applyInPandas(_search_shard(k), schema)

        best, before = over(0, 0, asks.withColumn("kth", F.lit(low))), []
        for first, last in waves(shards)[1:]:
            best = written(spark, best, "best")
            dropped(spark, *before)
            before = [best]
            kth = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(low)).alias("kth"))
            more = over(first, last, asks.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(low))))
            best = _ranked(best.unionByName(more), k).drop("rank")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def waves(shards: int) -> list[tuple[int, int]]:
    """First and last shard of each wave: 1, 2, 4, .. shards."""
    out, first, size = [], 0, 1
    while first < shards:
        out.append((first, min(first + size, shards) - 1))
        first, size = first + size, 2 * size
    return out


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 20 == 0)


SQL_OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
