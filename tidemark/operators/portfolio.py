"""Small driver-side steps on reduced tables: plateaus, clusters, combination weights, batches, zoom requests."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plateaus(effects: np.ndarray, floor: float) -> list[list[tuple[int, int]]]:
    """Connected cells of one sign whose absolute effect reaches floor, largest plateau first."""
    ok, seen, out = np.abs(effects) >= floor, set(), []
    rows, cols = effects.shape
    for start in zip(*np.nonzero(ok)):
        start = tuple(int(x) for x in start)
        if start in seen:
            continue
        seen.add(start)
        group, todo = [], [start]
        while todo:
            a, b = todo.pop()
            group.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < rows and 0 <= d < cols and ok[c, d] and (c, d) not in seen and np.sign(effects[c, d]) == np.sign(effects[start]):
                    seen.add((c, d))
                    todo.append((c, d))
        out.append(sorted(group))
    return sorted(out, key=lambda g: (-len(g), g[0]))


def linkage_clusters(corr: np.ndarray, limit: float = 0.30) -> list[int]:
    """Average-linkage clusters at distance 1 - |corr| up to limit; clusters are numbered by their first member."""
    groups = [[k] for k in range(len(corr))]
    distance = 1 - np.abs(corr)
    while len(groups) > 1:
        d, i, j = min((distance[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > limit:
            break
        groups[i] += groups.pop(j)
    label = {m: k for k, g in enumerate(sorted(groups, key=min)) for m in g}
    return [label[k] for k in range(len(corr))]


def combination_weights(cov: np.ndarray, expected: np.ndarray, cap: float = 0.35) -> np.ndarray:
    """Inverse-covariance weights, none below 0, none above cap; what the cap takes goes to the others in proportion."""
    w = np.maximum(np.linalg.pinv(cov) @ expected, 0.0)
    if w.sum() == 0:
        return w
    w /= w.sum()
    cap = max(cap, 1 / max((w > 0).sum(), 1))
    fixed = np.zeros(len(w), bool)
    while (over := (w > cap + 1e-12) & ~fixed).any():
        fixed |= over
        free = ~fixed & (w > 0)
        w[fixed] = cap
        if not free.any():
            break
        w[free] *= (1 - cap * fixed.sum()) / w[free].sum()
    return w


def positions(scores: DataFrame, decision: str, score: str, tail: float) -> DataFrame:
    """+1 in the upper tail of a decision's scores, -1 in the lower, scaled to unit gross."""
    n, w = F.count(score).over(Window.partitionBy(decision)), Window.partitionBy(decision)
    rank = F.percent_rank().over(w.orderBy(score))
    side = F.when(F.col(score).isNull() | (n < 2), 0).when(rank >= 1 - tail, 1).when(rank <= tail, -1).otherwise(0)
    out = scores.withColumn("side", side)
    return out.withColumn("position", F.col("side") / F.nullif(F.sum(F.abs("side")).over(w).cast("double"), F.lit(0.0)))


def batches(pairs: Iterable[tuple[str, str, tuple[str, ...]]], most: int) -> list[tuple[tuple[str, ...], list[tuple[str, str]]]]:
    """Pairs (a, b, targets) grouped by equal target sets and cut into blocks of at most `most`; orientation is kept."""
    by: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for a, b, targets in pairs:
        by.setdefault(tuple(sorted(targets)), []).append((a, b))
    return [(t, g[k : k + most]) for t, g in sorted(by.items()) for k in range(0, len(g), most)]


def resolved(requests: DataFrame, canonical: DataFrame) -> DataFrame:
    """Requested (first_id, second_id) joined to canonical rows; unknown ids and reversed orientation are errors."""
    on = ["first_id", "second_id"]
    found = requests.join(canonical, on)
    bad = requests.join(canonical, on, "left_anti")
    if not bad.isEmpty():
        back = canonical.select(F.col("second_id").alias("first_id"), F.col("first_id").alias("second_id"))
        kind = "reversed" if not bad.join(back, on, "left_semi").isEmpty() else "unknown"
        raise ValueError(f"{kind} pair: {tuple(bad.select(*on).first())}")
    return found


def tagged_union(parts: dict[int, DataFrame], expected: int) -> DataFrame:
    """Tables of several resolutions under one roof, with their resolution; the number of rows must be as expected."""
    out = None
    for k, df in sorted(parts.items()):
        df = df.withColumn("resolution", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if (n := out.count()) != expected:
        raise ValueError(f"{n} rows where {expected} are expected")
    return out
