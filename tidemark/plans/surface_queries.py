"""Bins, surfaces, inference and stability over lineitem: ship date = decision, supplier = security, tax = target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import columns as C
from tidemark.operators import surfaces as S
from tidemark.operators.features import pct_rank
from tidemark.sources.tables import table


def r6(c: str | Column, alias: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(alias) if alias else F.round(c.cast("double"), 6) + F.lit(0.0)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("decision"), F.col("l_suppkey").alias("security"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_extendedprice").alias("c"), (F.col("l_tax") * 10000).alias("y"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return li.withColumn("ra", C.average_rank(F.col("a"), ["decision"])).withColumn("rb", C.average_rank(F.col("b"), ["decision"]))


PANEL = f"""
p AS (SELECT *, {pct_rank("a", "decision")} AS ra, {pct_rank("b", "decision")} AS rb FROM (
  SELECT l_shipdate AS decision, l_suppkey AS security, l_quantity AS a, l_discount AS b, l_extendedprice AS c, l_tax * 10000 AS y, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem))
"""


def _bin(r: str, k: int) -> str:
    return f"CASE WHEN {r} IS NOT NULL THEN CAST(least(floor({r} * {k}), {k - 1}) AS INTEGER) END"


def _cells(k: int, more: str = "") -> str:
    return f"c AS (SELECT {_bin('ra', k)} * {k} + {_bin('rb', k)} AS cell{more}, count(y) AS n, sum(y) AS s, sum(y * y) AS q FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"


def _lift(k: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    sub = f"{by}, " if by else ""
    return f"""l AS (SELECT *, s / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) END AS sd, n / sum(n) OVER ({part}) AS frequency,
      s / n - sum(s) OVER (PARTITION BY {sub}cell // {k}) / sum(n) OVER (PARTITION BY {sub}cell // {k}) - sum(s) OVER (PARTITION BY {sub}cell % {k}) / sum(n) OVER (PARTITION BY {sub}cell % {k}) + sum(s) OVER ({part}) / sum(n) OVER ({part}) AS lift,
      cell // {k} AS a, cell % {k} AS b FROM c)"""


@register("surface_dual_3x3", f"WITH {PANEL}, {_cells(3)}, {_lift(3)} SELECT cell, n, round(mean, 6) AS mean_bps, round(sd, 6) AS sd, round(frequency, 6) AS frequency, round(lift, 6) + 0e0 AS lift, round(sd / sqrt(n), 6) AS se FROM l")
def surface_dual_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by decision, bins, cell moments, interaction lift."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 3)).withColumn("bb", C.rank_bin(F.col("rb"), 3))
    out = S.lifted(S.dual_cells(p, "ba", "bb", "y", 3), 3)
    return out.select("cell", "n", r6("mean", "mean_bps"), r6("sd", "sd"), r6("frequency", "frequency"), r6("lift", "lift"), r6("se", "se"))


@register("rank_bins", f"WITH {PANEL} SELECT security, round(a, 2) AS a, {_bin('ra', 3)} AS b3, {_bin('ra', 5)} AS b5, {_bin('ra', 10)} AS b10, {_bin('ra', 3)} + 3 * {_bin('ra', 5)} + 15 * {_bin('ra', 10)} AS packed, count(*) AS rows FROM p GROUP BY ALL")
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bins of a decision, packed and unpacked again."""
    p = panel(spark, sf_dir).withColumn("packed", C.packed(F.col("ra")))
    return p.select("security", F.round("a", 2).alias("a"), *(C.unpacked(F.col("packed"), k).alias(f"b{k}") for k in (3, 5, 10)), "packed").groupBy("security", "a", "b3", "b5", "b10", "packed").agg(F.count("*").alias("rows"))


_FUSED = " UNION ALL ".join(f"SELECT {k} AS resolution, {_bin('ra', k)} * {k} + {_bin('rb', k)} AS cell, count(y) AS n, round(sum(y), 3) AS s, round(sum(y * y), 1) AS q FROM p GROUP BY ALL" for k in (3, 5, 10))


@register("surface_fused_resolutions", f"WITH {PANEL} {_FUSED}")
def surface_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three resolutions from one shuffle on packed codes."""
    p = panel(spark, sf_dir).withColumn("pa", C.packed(F.col("ra"))).withColumn("pb", C.packed(F.col("rb")))
    return S.fused_cells(p, "pa", "pb", "y").select("resolution", "cell", "n", F.round("s", 3).alias("s"), F.round("q", 1).alias("q"))


@register("surface_single", f"WITH {PANEL}, x AS (SELECT 'quantity' AS feature, ra AS r, y FROM p UNION ALL SELECT 'discount', rb, y FROM p), t AS (SELECT feature, res, CASE WHEN r IS NOT NULL THEN CAST(least(floor(r * res), res - 1) AS INTEGER) END AS bin, count(y) AS n, avg(y) AS mean FROM x, (SELECT unnest([3, 5, 10]) AS res) GROUP BY ALL) SELECT feature, CAST(res AS INTEGER) AS resolution, bin, n, round(mean, 6) AS mean, round(n / sum(n) OVER (PARTITION BY feature, res), 6) AS frequency, round(mean * n / sum(n) OVER (PARTITION BY feature, res), 6) AS contribution, CAST(sign(mean) AS INTEGER) AS direction FROM t")
def surface_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-state surfaces of two features at three resolutions."""
    p = panel(spark, sf_dir)
    long = p.select(F.explode(F.array(F.struct(F.lit("quantity").alias("feature"), F.col("ra").alias("r")), F.struct(F.lit("discount").alias("feature"), F.col("rb").alias("r")))).alias("x"), "y").select("x.*", "y", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("resolution"))
    t = long.groupBy("feature", "resolution", F.when(F.col("r").isNotNull(), F.least(F.floor(F.col("r") * F.col("resolution")), F.col("resolution") - 1)).cast("int").alias("bin")).agg(F.count("y").alias("n"), F.avg("y").alias("mean"))
    freq = F.col("n") / F.sum("n").over(Window.partitionBy("feature", "resolution"))
    return t.select("feature", "resolution", "bin", "n", r6("mean", "mean"), r6(freq, "frequency"), r6(F.col("mean") * freq, "contribution"), F.signum("mean").cast("int").alias("direction"))


@register("surface_selected_cell", f"WITH {PANEL}, {_cells(5)}, {_lift(5)} SELECT cell, n, round(lift, 6) + 0e0 AS lift, round(frequency, 6) AS frequency FROM l ORDER BY abs(lift) DESC, cell LIMIT 1")
def surface_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of largest absolute lift."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 5)).withColumn("bb", C.rank_bin(F.col("rb"), 5))
    return S.selected(S.lifted(S.dual_cells(p, "ba", "bb", "y", 5), 5)).select("cell", "n", r6("lift", "lift"), r6("frequency", "frequency"))


@register("surface_neighbours", f"WITH {PANEL}, {_cells(5)}, {_lift(5)} SELECT x.cell, round(x.lift, 6) + 0e0 AS lift, round(coalesce(median(abs(y.lift)) FILTER (WHERE sign(y.lift) = sign(x.lift)), 0) / abs(x.lift), 5) AS retention, 1 + count(*) FILTER (WHERE sign(y.lift) = sign(x.lift) AND abs(y.lift) >= 0.5 * abs(x.lift)) AS plateau FROM l x LEFT JOIN l y ON abs(x.a - y.a) + abs(x.b - y.b) = 1 GROUP BY x.cell, x.lift")
def surface_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention by neighbours and plateau size."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 5)).withColumn("bb", C.rank_bin(F.col("rb"), 5))
    out = S.neighbour_support(S.lifted(S.dual_cells(p, "ba", "bb", "y", 5), 5), 5)
    return out.select("cell", r6("lift", "lift"), F.round("retention", 5).alias("retention"), "plateau")


_CLUSTER = f"""k AS (SELECT cell, decision, count(y) AS n_c, sum(y) AS s_c FROM (SELECT {_bin("ra", 3)} * 3 + {_bin("rb", 3)} AS cell, decision, y FROM p) GROUP BY ALL),
m AS (SELECT cell, sum(n_c) AS n, count(*) AS clusters, sum(s_c) / sum(n_c) AS mean FROM k GROUP BY ALL),
e AS (SELECT m.cell, any_value(m.n) AS n, any_value(m.clusters) AS clusters, any_value(m.mean) AS mean, sum(pow(s_c - m.mean * n_c, 2)) AS v FROM k JOIN m USING (cell) GROUP BY m.cell),
z AS (SELECT cell, n, clusters, mean, sqrt(v * clusters / (clusters - 1)) / n AS se FROM e)"""


@register("clustered_mean_bh", f"WITH {PANEL}, {_CLUSTER}, t AS (SELECT *, {C.normal_two_sided_sql('mean / se')} AS p FROM z), o AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM t) SELECT cell, CAST(n AS BIGINT) AS n, clusters, round(mean, 6) AS mean, round(se, 6) AS se, round(p, 6) AS p, round(least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q_value FROM o")
def clustered_mean_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered inference of each cell and step-up false-discovery control."""
    p = panel(spark, sf_dir).withColumn("cell", C.rank_bin(F.col("ra"), 3) * 3 + C.rank_bin(F.col("rb"), 3))
    out = C.benjamini_hochberg(S.clustered_mean(p, "y", "decision", ["cell"]), "p")
    return out.select("cell", "n", "clusters", *(r6(c, c) for c in ("mean", "se", "p", "q_value")))


@register("selected_cell_inference", f"WITH {PANEL}, {_cells(3)}, {_lift(3)}, g AS (SELECT cell, frequency FROM l ORDER BY abs(lift) DESC, cell LIMIT 1), d AS (SELECT decision, count(*) AS n_c, sum((CASE WHEN {_bin('ra', 3)} * 3 + {_bin('rb', 3)} = g.cell THEN 1 ELSE 0 END - g.frequency) * y) AS s_c FROM p, g GROUP BY decision), m AS (SELECT sum(n_c) AS n, sum(s_c) / sum(n_c) AS mean, count(*) AS k FROM d), e AS (SELECT any_value(n) AS n, any_value(mean) AS mean, any_value(k) AS k, sqrt(sum(pow(s_c - mean * n_c, 2)) * any_value(k) / (any_value(k) - 1)) / any_value(n) AS se FROM d, m) SELECT CAST(n AS BIGINT) AS n, k AS clusters, round(mean, 6) + 0e0 AS mean, round(se, 6) AS se, round(least({C.normal_two_sided_sql('mean / se')} * 9, 1), 6) AS p_selected FROM e")
def selected_cell_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected cell's contribution, clustered by session, with the selection paid for."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 3)).withColumn("bb", C.rank_bin(F.col("rb"), 3))
    chosen = S.selected(S.lifted(S.dual_cells(p, "ba", "bb", "y", 3), 3)).select(F.col("cell").alias("chosen"), "frequency")
    y = p.crossJoin(F.broadcast(chosen)).withColumn("z_", (F.when(F.col("ba") * 3 + F.col("bb") == F.col("chosen"), 1.0).otherwise(0.0) - F.col("frequency")) * F.col("y"))
    return S.clustered_mean(y, "z_", "decision").select("n", "clusters", r6("mean", "mean"), r6("se", "se"), r6(F.least(F.col("p") * 9, F.lit(1.0)), "p_selected"))


_FOLDS = "f AS (SELECT decision, CAST(ntile(5) OVER (ORDER BY decision) - 1 AS INTEGER) AS fold FROM (SELECT DISTINCT decision FROM p))"


@register("fold_effects", f"WITH {PANEL}, {_FOLDS}, x AS (SELECT {_bin('ra', 3)} AS bin, fold, avg(y) - 400 AS effect FROM p JOIN f USING (decision) GROUP BY ALL) SELECT bin, count(*) AS folds, round(abs(avg(sign(effect))), 6) AS sign_consistency, round(min(abs(effect)) / max(abs(effect)), 5) AS magnitude_ratio FROM x GROUP BY bin")
def fold_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of an effect's sign and size over runs of sessions."""
    p = S.folds(panel(spark, sf_dir), "decision", 5).withColumn("bin", C.rank_bin(F.col("ra"), 3))
    x = p.groupBy("bin", "fold").agg((F.avg("y") - 400).alias("effect"))
    return x.groupBy("bin").agg(F.count("*").alias("folds"), r6(F.abs(F.avg(F.signum("effect"))), "sign_consistency"), F.round(F.min(F.abs("effect")) / F.max(F.abs("effect")), 5).alias("magnitude_ratio"))


@register("cell_specialist", f"WITH {PANEL}, s AS (SELECT {_bin('ra', 3)} AS cell, security, count(y) AS n, sum(y - 400) AS s FROM p GROUP BY ALL), r AS (SELECT *, CASE WHEN n >= 20 THEN s / n END AS local, row_number() OVER (PARTITION BY cell ORDER BY round(abs(s), 6) DESC, security) AS r FROM s) SELECT cell, count(*) AS symbols, count(local) AS eligible, round(avg(CASE WHEN local > 0 THEN 1e0 WHEN local IS NOT NULL THEN 0e0 END), 6) AS positive_share, round(stddev_samp(local), 6) AS dispersion, round(sum(CASE WHEN r <= 1 THEN abs(s) ELSE 0 END) / sum(abs(s)), 6) AS top1_share, round(sum(CASE WHEN r <= 5 THEN abs(s) ELSE 0 END) / sum(abs(s)), 6) AS top5_share, round(max(local), 6) AS best_local, round(min(local), 6) + 0e0 AS worst_local, round(avg(abs(local)) / abs(sum(s) / sum(n)), 4) AS cancellation FROM r GROUP BY cell")
def cell_specialist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of a cell's effect over symbols."""
    p = panel(spark, sf_dir).withColumn("cell", C.rank_bin(F.col("ra"), 3)).withColumn("y", F.col("y") - 400)
    out = S.specialist(p, "cell", "security", "y", 20)
    return out.select("cell", "symbols", "eligible", *(r6(c, c) for c in ("positive_share", "dispersion", "top1_share", "top5_share", "best_local", "worst_local")), F.round("cancellation", 4).alias("cancellation"))


@register("cell_temporal", f"WITH {PANEL}, {_FOLDS}, s AS (SELECT {_bin('ra', 5)} AS cell, fold, count(y) AS n, avg(y - 400) AS m FROM p JOIN f USING (decision) GROUP BY ALL) SELECT cell, round(avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END), 6) AS positive_folds, round(avg(CASE WHEN m < 0 THEN 1e0 ELSE 0e0 END), 6) AS negative_folds, round(min(m), 6) AS worst, round(max(m), 6) AS best, round(median(m), 6) AS median, round(stddev_samp(m), 6) AS dispersion, min(n) AS least_n, count(*) AS populated, CAST(5 AS BIGINT) AS expected, CASE WHEN count(*) < 5 THEN 0 ELSE min(n) END AS least_n_all FROM s GROUP BY cell")
def cell_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's effect over folds."""
    p = S.folds(panel(spark, sf_dir), "decision", 5).withColumn("cell", C.rank_bin(F.col("ra"), 5)).withColumn("y", F.col("y") - 400)
    out = S.temporal(p, "cell", "fold", "y", 5)
    return out.select("cell", *(r6(c, c) for c in ("positive_folds", "negative_folds", "worst", "best", "median", "dispersion")), "least_n", "populated", "expected", "least_n_all")


@register("grouping_sets_distribution", f"WITH {PANEL}, x AS (SELECT {_bin('ra', 3)} AS cell, security, month, y FROM p) SELECT cell, security, month, CAST(grouping(security) AS INTEGER) AS g_security, CAST(grouping(month) AS INTEGER) AS g_month, count(*) AS observations, count(DISTINCT security) AS symbols, round(avg(y), 6) AS mean_bps, round(median(y), 6) AS median_bps, round(avg(CASE WHEN y > 400 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, round(stddev_samp(y), 6) AS dispersion_bps FROM x GROUP BY GROUPING SETS ((cell), (cell, security), (cell, month))")
def grouping_sets_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of a cell, its symbols and its months in one pass."""
    x = panel(spark, sf_dir).select(C.rank_bin(F.col("ra"), 3).alias("cell"), "security", "month", "y", F.col("security").alias("who"))
    cols = [F.col("cell"), F.col("security"), F.col("month")]
    return x.groupingSets([[cols[0]], cols[:2], [cols[0], cols[2]]], *cols).agg(F.grouping("security").cast("int").alias("g_security"), F.grouping("month").cast("int").alias("g_month"), F.count("*").alias("observations"), F.count_distinct("who").alias("symbols"), r6(F.avg("y"), "mean_bps"), r6(F.percentile("y", F.lit(0.5)), "median_bps"), r6(F.avg((F.col("y") > 400).cast("double")), "win_rate"), r6(F.stddev_samp("y"), "dispersion_bps"))


@register("segmented_moments", f"WITH {PANEL} SELECT {_bin('ra', 3)} * 3 + {_bin('rb', 3)} AS cell, month, count(y) AS n, round(sum(y), 3) AS s, round(sum(y * y), 1) AS q FROM p WHERE month >= '1995' GROUP BY ALL")
def segmented_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell moments by group; rows outside the groups are left out."""
    p = panel(spark, sf_dir).where("month >= '1995'").withColumn("ba", C.rank_bin(F.col("ra"), 3)).withColumn("bb", C.rank_bin(F.col("rb"), 3))
    return S.dual_cells(p, "ba", "bb", "y", 3, ["month"]).select("cell", "month", "n", F.round("s", 3).alias("s"), F.round("q", 1).alias("q"))


@register("sweep_summary", f"WITH {PANEL}, {_cells(10)} SELECT count(*) AS populated, count(*) FILTER (WHERE s / n > 400) AS positive, count(*) FILTER (WHERE s / n < 400) AS negative, count(*) FILTER (WHERE s / n = 400) AS zero, round(max(abs(s / n - 400)), 6) AS most FROM c")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of cells by sign, and the largest effect."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 10)).withColumn("bb", C.rank_bin(F.col("rb"), 10))
    m = F.col("s") / F.col("n") - 400
    return S.dual_cells(p, "ba", "bb", "y", 10).agg(F.count("*").alias("populated"), F.count_if(m > 0).alias("positive"), F.count_if(m < 0).alias("negative"), F.count_if(m == 0).alias("zero"), r6(F.max(F.abs(m)), "most"))


@register("rank_ic", f"WITH {PANEL}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ka, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ky FROM p) SELECT count(*) AS n, round(corr(ka, ky), 6) AS rank_ic FROM r")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation. Ranks come from the counts of distinct values, so no window holds all rows."""
    p = panel(spark, sf_dir).select("a", "y").where("a IS NOT NULL AND y IS NOT NULL")

    def ranked(c: str) -> DataFrame:
        v = C.sum_before(p.groupBy(c).agg(F.count("*").alias("k")), c, F.col("k"))
        return v.select(F.col(c), (F.col("before") + (F.col("k") + 1) / 2).alias(f"k{c}"))

    return p.join(ranked("a"), "a").join(ranked("y"), "y").agg(F.count("*").alias("n"), r6(F.corr("ka", "ky"), "rank_ic"))


@register("quantile_spread", f"WITH {PANEL}, q AS (SELECT decision, quantile_cont(c, 0.9) AS hi, quantile_cont(c, 0.1) AS lo, count(c) AS n FROM p GROUP BY decision), x AS (SELECT decision, CASE WHEN c >= hi THEN 1 WHEN c <= lo THEN -1 ELSE 0 END AS signal, y FROM p JOIN q USING (decision) WHERE n >= 20 AND lo < hi) SELECT count(*) AS n, count(DISTINCT decision) AS decisions, round(avg(y) FILTER (WHERE signal = 1) - avg(y) FILTER (WHERE signal = -1), 6) + 0e0 AS spread, round(avg(signal * y), 6) + 0e0 AS contribution FROM x")
def quantile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals from the tails of each decision with 20 names or more, and their spread."""
    p = panel(spark, sf_dir)
    q = p.groupBy("decision").agg(F.percentile("c", F.lit(0.9)).alias("hi"), F.percentile("c", F.lit(0.1)).alias("lo"), F.count("c").alias("k")).where("k >= 20 AND lo < hi")
    x = p.join(q, "decision").withColumn("signal", F.when(F.col("c") >= F.col("hi"), 1).when(F.col("c") <= F.col("lo"), -1).otherwise(0))
    return x.agg(F.count("*").alias("n"), F.count_distinct("decision").alias("decisions"), r6(F.avg(F.when(F.col("signal") == 1, F.col("y"))) - F.avg(F.when(F.col("signal") == -1, F.col("y"))), "spread"), r6(F.avg(F.col("signal") * F.col("y")), "contribution"))


@register("stability_score", f"WITH {PANEL}, {_CLUSTER}, t AS (SELECT *, {C.normal_two_sided_sql('(mean - 400) / se')} AS p, abs(mean - 400) AS effect FROM z) SELECT cell, CAST(n AS BIGINT) AS n, round(CASE WHEN n >= 100 AND p < 0.9 THEN cume_dist() OVER (ORDER BY effect) * -log10(greatest(p, 1e-300)) * ln(1 + n) END, 4) AS score FROM t")
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, and a score of effect rank, evidence and size; a row that fails has none."""
    p = panel(spark, sf_dir).withColumn("cell", C.rank_bin(F.col("ra"), 3) * 3 + C.rank_bin(F.col("rb"), 3)).withColumn("y", F.col("y") - 400)
    t = S.clustered_mean(p, "y", "decision", ["cell"])
    rank = F.cume_dist().over(Window.orderBy(F.abs("mean")))
    score = rank * -F.log10(F.greatest("p", F.lit(1e-300))) * F.log1p(F.col("n").cast("double"))
    return t.select("cell", "n", F.round(F.when((F.col("n") >= 100) & (F.col("p") < 0.9), score), 4).alias("score"))


@register("time_bucket_groups", "SELECT bucket, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT value, CASE WHEN m < 570 OR m > 960 THEN NULL WHEN m >= 900 THEN 'close' WHEN m < 630 THEN 'open' WHEN m < 720 THEN 'morning' WHEN m < 840 THEN 'midday' ELSE 'afternoon' END AS bucket FROM (SELECT value, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM events)) WHERE bucket IS NOT NULL GROUP BY bucket")
def time_bucket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the clock; the order of the tests matters."""
    m = F.hour("ts") * 60 + F.minute("ts")
    bucket = F.when((m < 570) | (m > 960), None).when(m >= 900, "close").when(m < 630, "open").when(m < 720, "morning").when(m < 840, "midday").otherwise("afternoon")
    return table(spark, sf_dir, "events").select("value", bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))


@register("alias_elimination", "SELECT 'discount' AS feature, 'discount' AS kept UNION ALL SELECT 'discount_copy', 'discount' UNION ALL SELECT 'quantity', 'quantity'")
def alias_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose realised bins are equal everywhere keep the first name; an order-free hash of (id, bin) decides."""
    p = panel(spark, sf_dir)
    long = p.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), C.rank_bin(F.col(r), 10).alias("bin")) for n, r in (("quantity", "ra"), ("discount", "rb"), ("discount_copy", "rb"))))).alias("x"), "decision", "security", "a", "b").select("x.*", "decision", "security", "a", "b")
    h = long.groupBy("feature").agg(F.sum(F.xxhash64("decision", "security", "a", "b", "bin").cast("decimal(38,0)")).alias("h"), F.count("*").alias("k"))
    return h.select("feature", F.min("feature").over(Window.partitionBy("h", "k")).alias("kept"))


@register("pair_plan", "WITH f AS (SELECT DISTINCT p_brand AS id FROM part) SELECT a.id AS a, b.id AS b, substr(sha256(a.id || chr(0) || b.id), 1, 24) AS pair_id FROM f a JOIN f b ON a.id < b.id")
def pair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unordered pairs of a catalogue, with their ids."""
    from tidemark.operators.joins import pairs_of

    out = pairs_of(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct(), "id")
    return out.select("a", "b", F.substring(F.sha2(F.concat("a", F.lit("\0"), "b"), 256), 1, 24).alias("pair_id"))


@register("cell_evidence_view", f"WITH {PANEL}, {_cells(3)}, {_lift(3)} SELECT cell, n, round(mean - 400, 6) + 0e0 AS raw_edge_bps, round(frequency, 6) AS frequency, round(sd / sqrt(n), 6) AS se, round(lift, 6) + 0e0 AS lift FROM l WHERE cell > 2 ORDER BY cell LIMIT 4")
def cell_evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces stored as arrays, exploded into cells again, and a page of them after a key."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 3)).withColumn("bb", C.rank_bin(F.col("rb"), 3))
    cells = S.dual_cells(p, "ba", "bb", "y", 3)
    packed = cells.agg(F.sort_array(F.collect_list(F.struct("cell", "n", "s", "q"))).alias("surface"))
    back = packed.select(F.explode("surface").alias("x")).select("x.*")
    out = S.lifted(back, 3).where("cell > 2").orderBy("cell").limit(4)
    return out.select("cell", "n", r6(F.col("mean") - 400, "raw_edge_bps"), r6("frequency", "frequency"), r6("se", "se"), r6("lift", "lift"))
