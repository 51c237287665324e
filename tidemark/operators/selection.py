"""Selections over evidence: survivors, winners by role, oriented cells, tail masks, conditions, unions of cells, groupings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(tests: DataFrame, feature: str, p: str, statistic: str, alpha: float, most: int) -> DataFrame:
    """Features by their least p and largest statistic: those with p <= alpha, `most` at most; with fewer than two of these, the best `most`. Input is a reduced table of tests."""
    best = tests.groupBy(feature).agg(F.min(p).alias("best_p"), F.max(F.abs(F.col(statistic))).alias("best_statistic"))
    order = [F.col("best_p").asc_nulls_last(), F.col("best_statistic").desc(), F.col(feature)]
    passes = F.coalesce(F.col("best_p") <= alpha, F.lit(False))
    x = best.withColumn("_passes", passes).withColumn("_n", F.count_if("_passes").over(Window.partitionBy()))
    x = x.withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # survivors come first in this order, one row a feature
    return x.where((F.col("_place") <= most) & ((F.col("_n") < 2) | F.col("_passes"))).drop("_passes", "_n", "_place")


def role_winners(rows: DataFrame, family: str, key: str, roles: dict[str, Column], ties: list[str], cap: int) -> DataFrame:
    """Of each family the row with the largest measure of each role (ties by columns), with all roles that a row wins; rows in the order of their first role, `cap` a family at most."""
    held = rows.select("*", *(m.alias(f"_m{i}") for i, m in enumerate(roles.values())))
    places = {f"_p{i}": F.row_number().over(Window.partitionBy(family).orderBy(F.col(f"_m{i}").desc_nulls_last(), *ties, key)) for i in range(len(roles))}
    won = held.withColumns(places)
    flags = [F.when((F.col(f"_p{i}") == 1) & F.col(f"_m{i}").isNotNull(), F.lit(i)) for i in range(len(roles))]
    won = won.withColumn("_roles", F.array_compact(F.array(*flags))).where(F.size("_roles") > 0)
    won = won.withColumn("_place", F.row_number().over(Window.partitionBy(family).orderBy(F.element_at("_roles", 1), key))).where(F.col("_place") <= cap)
    names = F.array(*map(F.lit, roles))
    won = won.withColumn("roles", F.array_join(F.transform("_roles", lambda i: F.element_at(names, i + 1)), "|"))
    return won.drop("_roles", "_place", *places, *(f"_m{i}" for i in range(len(roles))))


def oriented(a: Column, b: Column, cells: Column, resolution: int) -> Column:
    """A pair in the order of its ids with its cells in ascending order, each once: swapping the two transposes the cells."""
    turned = F.transform(cells, lambda c: F.pmod(c, F.lit(resolution)) * resolution + F.floor(c / resolution).cast("int"))
    swap = a > b
    own = F.array_sort(F.array_distinct(F.when(swap, turned).otherwise(cells)))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), own.alias("cells"))


def tail_mask(sides: Iterable[tuple[Column, Column, int]], resolution: int, fraction: float) -> Column | None:
    """Rows in the outer tails of the selected states. sides: (rank, state, selected state); an outer state narrows to its tail, an inner one stays as it is. None where no side is outer."""
    sides = list(sides)
    if not 0 < fraction <= 0.5:
        raise ValueError("a tail is at most half")
    if all(selected not in (0, resolution - 1) for _, _, selected in sides):
        return None
    tests = [rank < fraction if selected == 0 else rank >= 1 - fraction if selected == resolution - 1 else state == selected for rank, state, selected in sides]
    return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))


def condition(value: Column, cuts: list[float], labels: list[str], missing: str = "unavailable") -> Column:
    """The label of a value by ascending cut points (a cut belongs to the label above it). A missing value has the label `missing`, or none if it is unavailable."""
    if len(labels) != len(cuts) + 1 or sorted(cuts) != list(cuts) or missing not in ("unavailable", "category"):
        raise ValueError("a condition has ascending cuts and one label more")
    known = value.isNotNull() & ~F.isnan(value.cast("double"))
    found = reduce(lambda c, k: c.when(value < cuts[k], labels[k]), range(len(cuts)), F.when(F.lit(False), "")).otherwise(labels[-1])
    return F.when(known, found).otherwise(F.lit("missing") if missing == "category" else F.lit(None).cast("string"))


def groupings(df: DataFrame, sets: list[tuple[str, ...]], y: str) -> DataFrame:
    """grouping (its columns by "_"), group (their values by "|"), n, mean: all sets in one aggregation. Rows that lack a value of a set have no group in it."""
    columns = sorted({c for s in sets for c in s})
    out = df.select(*(F.col(c).cast("string").alias(c) for c in columns), F.col(y).alias("_y"))
    rows = F.explode(F.array(*(F.struct(F.lit("_".join(s)).alias("grouping"), F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in s)), F.concat_ws("|", *s)).alias("group")) for s in sets)))
    return out.select(rows.alias("g"), "_y").select("g.*", "_y").where("group IS NOT NULL").groupBy("grouping", "group").agg(F.count("_y").alias("n"), F.avg("_y").alias("mean"))


def cell_union(df: DataFrame, cell: str, cells: list[int], resolution: int, y: str) -> DataFrame:
    """n, sum, mean and frequency of a union of distinct cells of a surface, from one pass."""
    if not cells or len(set(cells)) != len(cells) or not all(0 <= c < resolution for c in cells):
        raise ValueError("a union holds distinct cells of one resolution")
    inside = F.col(cell).isin(cells)
    return df.where(F.col(cell).isNotNull() & F.col(y).isNotNull()).agg(F.count_if(inside).alias("n"), F.sum(F.when(inside, F.col(y))).alias("sum_y"), F.avg(F.when(inside, F.col(y))).alias("mean"), F.try_divide(F.count_if(inside), F.count("*")).alias("frequency"))


def pending(planned: DataFrame, journal: DataFrame, keys: list[str], done: Iterable[str] = ("done", "empty")) -> DataFrame:
    """Planned tasks without a finished entry in the journal: what a resumed run has left to do."""
    return planned.join(journal.where(F.col("status").isin(*done)).select(*keys).distinct(), keys, "left_anti")


def weekdays(a: Column, b: Column) -> Column:
    """Mondays to Fridays in [a, b)."""

    def before(d: Column) -> Column:
        n = F.datediff(d, F.lit("1969-12-29").cast("date"))  # a Monday
        return 5 * F.floor(n / 7) + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return before(b) - before(a)


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coefficient of the least-squares fit with an intercept, from one row of sums; the columns are centred so that the sums keep their digits."""
    import numpy as np

    known = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [y, *xs])))
    names = [*xs, y]
    sums = known.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names)))).first()
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    slope, *_ = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=None)
    means = np.array([sums[f"m{i}"] for i in range(len(names))], float)
    rows = [("intercept", float(means[-1] - slope @ means[:-1])), *zip(xs, map(float, slope))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")
