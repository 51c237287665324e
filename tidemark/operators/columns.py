"""Column-level building blocks: missing values, ranks, bins, packing, multiple testing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Non-finite values become NULL: only NULL is missing."""
    d = c.cast("double")
    return F.when(~(F.isnan(d) | (F.abs(d) == float("inf"))), d)


def safe_div(a: Column, b: Column, eps: float = 2.2e-16) -> Column:
    return F.when(F.abs(b) > eps, a / b)


def average_rank(value: Column, by: Iterable[str]) -> Column:
    """Percentile rank with average ties among known values: (rank + (ties - 1) / 2) / n."""
    known = [*by, value.isNull()]
    ties = F.count(F.lit(1)).over(Window.partitionBy(*known, value)).cast("double")
    rank = F.rank().over(Window.partitionBy(*known).orderBy(value)).cast("double")
    return F.when(value.isNotNull(), (rank + (ties - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy(*known)))


def mid_rank(value: Column, by: Iterable[str]) -> Column:
    """(average rank - 0.5) / n."""
    known = [*by, value.isNull()]
    n = F.count(F.lit(1)).over(Window.partitionBy(*known)).cast("double")
    return average_rank(value, by) - 0.5 / n


def rank_bin(rank: Column, bins: int) -> Column:
    return F.when(rank.isNotNull(), F.least(F.floor(rank * bins), F.lit(bins - 1))).cast("int")


def packed(rank: Column) -> Column:
    """Bins of 3, 5 and 10 in one number: b3 + 3 b5 + 15 b10; 255 where the rank is missing."""
    return F.coalesce(rank_bin(rank, 3) + 3 * rank_bin(rank, 5) + 15 * rank_bin(rank, 10), F.lit(255)).cast("int")


def unpacked(code: Column, bins: int) -> Column:
    part = {3: F.pmod(code, F.lit(3)), 5: F.pmod(F.floor(code / 3), F.lit(5)), 10: F.floor(code / 15)}[bins]
    return F.when(code < 255, part).cast("int")


def sum_before(df: DataFrame, by: str, add: Column, then: Iterable[str] = (), *, falling: bool = False, rows: int = 1_000_000, out: str = "before") -> DataFrame:
    """df with the sum of `add` over all rows before each one in the order of a numeric column (then of others), without one task that holds all rows.

    Rows are laid into ranges of about `rows` (64 ranges at least) by approximate quantiles; each range is ordered by
    itself, and the sums of the ranges before it are added. Equal values share a range. Known values only.
    """
    df = df.where(F.col(by).isNotNull())
    quantiles = lambda n: F.percentile_approx(F.col(by).cast("double"), [k / n for k in range(1, n)], max(1000, 8 * n))
    n, cuts = df.agg(F.count("*"), quantiles(64)).first()
    if n > 64 * rows:
        cuts = df.agg(quantiles(-(-n // rows))).first()[0]
    cuts = sorted(set(cuts or []))
    # the range's number by halves: a row is compared with few cuts, however many there are
    def among(lo: int, hi: int) -> Column:
        if hi - lo <= 16:
            return reduce(lambda a, b: a + b, (F.when(F.col(by) >= F.lit(c), 1).otherwise(0) for c in cuts[lo:hi]), F.lit(lo))
        mid = (lo + hi) // 2
        return F.when(F.col(by) >= F.lit(cuts[mid]), among(mid, hi)).otherwise(among(lo, mid))

    part = among(0, len(cuts))
    df = df.withColumn("_add", add.cast("double")).withColumn("_range", -part if falling else part)
    own = Window.partitionBy("_range").orderBy(F.desc(by) if falling else F.asc(by), *then).rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("_range").agg(F.sum("_add").alias("_t"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_offset"))  # one row a range
    return df.join(F.broadcast(ranges), "_range").withColumn(out, F.col("_offset") + F.coalesce(F.sum("_add").over(own), F.lit(0.0))).drop("_range", "_add", "_offset")


def quantile_group(before: Column, n: Column, k: int) -> Column:
    """ntile(k) from a row's place and the number of rows: the first n mod k groups have one row more."""
    q, r = F.floor(n / k), n % k
    return (F.when(before < r * (q + 1), F.floor(before / (q + 1))).otherwise(r + F.floor((before - r * (q + 1)) / q)) + 1).cast("long")


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q_value", invalid_as_one: bool = False) -> DataFrame:
    """Step-up adjusted p values by a reverse running minimum. Input: one row a test, an already reduced table."""
    valid = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    df = df.withColumn("_p", F.when(valid, F.col(p)).otherwise(F.lit(1.0) if invalid_as_one else F.lit(None).cast("double")))
    known = F.col("_p").isNotNull()
    m = F.count("_p").over(Window.partitionBy()).cast("double")
    rank = F.row_number().over(Window.partitionBy(known).orderBy("_p")).cast("double")
    df = df.withColumn("_m", m).withColumn("_r", rank)
    back = Window.partitionBy(known).orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    q = F.least(F.min(F.col("_p") * F.col("_m") / F.col("_r")).over(back), F.lit(1.0))
    return df.withColumn(out, F.when(known, q)).drop("_p", "_m", "_r")


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by the rational form of Abramowitz and Stegun 26.2.17, in expressions (error below 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2 * poly * F.exp(-x * x / 2) * 0.3989422804014327, F.lit(1.0))


#: The same as SQL text.
def normal_two_sided_sql(z: str) -> str:
    t = f"(1e0 / (1e0 + 0.2316419e0 * abs({z})))"
    return f"least(2e0 * {t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0)))) * exp(-({z}) * ({z}) / 2e0) * 0.3989422804014327e0, 1e0)"
