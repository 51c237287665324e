"""Single variables scanned together: signals of each decision's tails, clustered inference over all rows and by fold, gates and a score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.columns import benjamini_hochberg, normal_two_sided

#: Fractions of the tails (the middle one is the signal, the others its neighbours), least names of a decision.
TAILS, NAMES = (0.05, 0.1, 0.2), 20


@dataclass(frozen=True)
class Gates:
    """Limits of a stable effect (fixed values by default)."""

    q: float = 0.05
    folds: int = 2
    consistency: float = 0.6
    magnitude: float = 0.05
    active: int = 20
    outlier: float = 0.25
    retention: float = 0.25
    plateau: int = 2


def scans(df: DataFrame, features: list[str], y: str, decision: str, fold: str) -> DataFrame:
    """One row a feature: n, effect, p_value, folds, consistency and magnitude of the folds' effects, retention and plateau of the neighbours, active, outlier_share.

    Features are laid under each other, so that two shuffles (by feature and decision) serve all of them."""
    long = df.select(F.col(decision).alias("_d"), F.col(fold).alias("_f"), F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features))).alias("_x")).select("_d", "_f", "_y", "_x.*").where("x IS NOT NULL")
    cuts = long.groupBy("feature", "_d").agg(F.count("*").alias("_names"), *(F.percentile("x", F.lit(v)).alias(f"_{side}{k}") for k, t in enumerate(TAILS) for side, v in (("lo", t), ("hi", 1 - t))))
    signal = lambda k: F.when((F.col("_names") >= NAMES) & (F.col(f"_lo{k}") < F.col(f"_hi{k}")), F.when(F.col("x") <= F.col(f"_lo{k}"), -1).when(F.col("x") >= F.col(f"_hi{k}"), 1).otherwise(0)).otherwise(0)
    rows = long.join(cuts, ["feature", "_d"]).where("_y IS NOT NULL").select("feature", "_d", "_f", "_y", *(signal(k).alias(f"_s{k}") for k in range(3)))
    c = rows.groupBy("feature", "_f", "_d").agg(F.count("*").alias("n"), *(F.sum(F.col(f"_s{k}") * F.col("_y")).alias(f"t{k}") for k in range(3)), F.count_if(F.col("_s1") != 0).alias("active"))
    by = c.groupBy("feature", "_f").agg(F.try_divide(F.sum("t1"), F.sum("n")).alias("e")).groupBy("feature").agg(F.count("e").alias("folds"), F.percentile("e", F.lit(0.5)).alias("middle"), F.abs(F.avg(F.signum("e"))).alias("consistency"))
    d = c.groupBy("feature", "_d").agg(F.sum("n").alias("n"), *(F.sum(f"t{k}").alias(f"t{k}") for k in range(3)), F.sum("active").alias("active"))
    a = d.groupBy("feature").agg(
        F.sum("n").alias("n"), *(F.try_divide(F.sum(f"t{k}"), F.sum("n")).alias(f"e{k}") for k in range(3)), F.sum("active").alias("active"), F.try_divide(F.max(F.abs("t1")), F.sum(F.abs("t1"))).alias("outlier_share"),
        F.count("*").cast("double").alias("g"), F.sum(F.col("t1") * F.col("t1")).alias("tt"), F.sum(F.col("t1") * F.col("n")).alias("tn"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
    )
    centred = F.greatest(F.col("tt") - 2 * F.col("e1") * F.col("tn") + F.col("e1") * F.col("e1") * F.col("nn"), F.lit(0.0))
    se = F.when((F.col("n") >= 3) & (F.col("g") > 1), F.sqrt(centred * F.col("g") / F.nullif(F.col("g") - 1, F.lit(0.0))) / F.col("n"))
    kept = lambda k: F.when((F.col("e1") != 0) & (F.signum(f"e{k}") == F.signum("e1")), F.try_divide(F.abs(f"e{k}"), F.abs("e1")))
    a = a.join(by, "feature").withColumn("se", se).withColumn("p_value", normal_two_sided(F.try_divide("e1", "se"))).withColumn("r0", kept(0)).withColumn("r2", kept(2))
    half = lambda k: F.coalesce((F.col(f"r{k}") >= 0.5).cast("int"), F.lit(0))
    return a.select(
        "feature", "n", F.col("e1").alias("effect"), "se", "p_value", "folds", "consistency", F.least(F.lit(1.0), F.try_divide(F.abs("middle"), F.abs("e1"))).alias("magnitude"),
        F.coalesce((F.coalesce("r0", "r2") + F.coalesce("r2", "r0")) / 2, F.lit(0.0)).alias("retention"), (1 + half(0) + half(2)).alias("plateau"), "active", "outlier_share",
    )


def gated(scanned: DataFrame, gates: Gates) -> DataFrame:
    """scanned with q_value (an invalid test counts as p = 1), passes, and the score of those that pass. Input: one row a test, a reduced table."""
    x = benjamini_hochberg(scanned, "p_value", invalid_as_one=True)
    limits = [F.col("q_value") <= gates.q, F.col("folds") >= gates.folds, F.col("consistency") >= gates.consistency, F.col("magnitude") >= gates.magnitude, F.col("active") >= gates.active, F.col("outlier_share") <= gates.outlier, F.col("retention") >= gates.retention, F.col("plateau") >= gates.plateau]
    ok = limits[0]
    for test in limits[1:]:
        ok = ok & test
    x = x.withColumn("passes", F.coalesce(ok, F.lit(False))).withColumn("_place", F.cume_dist().over(Window.orderBy(F.round(F.abs("effect"), 12))))
    score = F.col("_place") * -F.log10(F.greatest("q_value", F.lit(1e-300))) * F.col("consistency") * F.col("magnitude") * F.greatest("retention", F.lit(0.01)) * F.log1p(F.col("n").cast("double"))
    return x.withColumn("score", F.when(F.col("passes"), score)).drop("_place")
