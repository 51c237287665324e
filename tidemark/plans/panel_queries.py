"""Bars, sessions, universe and targets over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import columns as C
from tidemark.operators import panel as P
from tidemark.plans.surface_queries import r6
from tidemark.sources.tables import BARS_SQL, bars, table


def r6s(*names: str):
    return [r6(n, n) for n in names]


@register("bar_rollup", "WITH b AS (SELECT user_id, month, open, high, low, close, volume, vwap, trade_count, (row_number() OVER (PARTITION BY user_id, month ORDER BY session_date) - 1) // 5 AS bucket, session_date FROM (SELECT security_id AS user_id, strftime(session_date, '%Y-%m') AS month, * FROM (" + BARS_SQL + "))) SELECT user_id, month, CAST(bucket AS INTEGER) AS bucket, round(arg_min(open, session_date), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, session_date), 6) AS close, round(sum(volume), 4) AS volume, count(*) AS constituent_bars, round(sum(vwap * volume) / nullif(sum(volume), 0), 6) AS vwap, sum(trade_count) AS trade_count FROM b GROUP BY ALL")
def bar_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of five bars by ordinal."""
    b = bars(spark, sf_dir).withColumn("month", F.date_format("session_date", "yyyy-MM")).withColumnRenamed("security_id", "user_id")
    out = P.rollup(b, ["user_id", "month"], ["session_date"], 5)
    return out.select("user_id", "month", "bucket", *r6s("open", "high", "low", "close"), F.round("volume", 4).alias("volume"), "constituent_bars", r6("vwap", "vwap"), "trade_count")


def _session_sql(minutes: tuple[int, ...] = (60, 240)) -> str:
    cols = []
    for k in minutes:
        cols.append(f"round(arg_max(value, t) FILTER (WHERE o <= {k}) / nullif(arg_min(value, t), 0) - 1, 6) + 0e0 AS opening_return_{k}m, round(arg_max(value, t) / nullif(arg_min(value, t) FILTER (WHERE c <= {k}), 0) - 1, 6) + 0e0 AS closing_return_{k}m, round((max(value) FILTER (WHERE o <= {k}) - min(value) FILTER (WHERE o <= {k})) / nullif(arg_min(value, t), 0), 6) AS opening_range_pct_{k}m, round(sum(v) FILTER (WHERE c <= {k}) / sum(v), 6) AS closing_volume_share_{k}m, round(sum(v) FILTER (WHERE o <= {k}), 4) AS opening_volume_{k}m")
    return f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 60e6 AS t, value, 1e0 + event_id % 7 AS v FROM events),
x AS (SELECT *, t - min(t) OVER d AS o, max(t) OVER d - t AS c, sign(value - sum(value * v) OVER r / sum(v) OVER r) AS side, sum(v) OVER (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v5 FROM e WINDOW d AS (PARTITION BY user_id, day), r AS (PARTITION BY user_id, day ORDER BY t)),
y AS (SELECT *, CASE WHEN side * lag(side) OVER (PARTITION BY user_id, day ORDER BY t) < 0 THEN 1 ELSE 0 END AS x FROM x)
SELECT user_id, day, round(arg_min(value, t), 6) AS session_open, round(arg_max(value, t), 6) AS session_close, round(max(value), 6) AS session_high, round(min(value), 6) AS session_low, sum(v) AS session_volume, round(sum(value * v) / sum(v), 6) AS session_vwap, CAST(sum(x) AS BIGINT) AS vwap_cross_count, round(avg(CASE WHEN side > 0 THEN 1e0 ELSE 0e0 END), 6) AS time_above_vwap, round(max(v) / sum(v), 6) AS largest_1_share, round(max(v5) / sum(v), 6) AS largest_5_share, {", ".join(cols)} FROM y GROUP BY ALL"""


@register("session_metrics", _session_sql())
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D4, and the session concepts that come from it."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "value", (1.0 + F.col("event_id") % 7).alias("v"))
    out = P.session_metrics(e, ["user_id", "day"], "ts", "value", "v", (60, 240))
    wide = [c for c in out.columns if c not in ("user_id", "day", "session_volume", "vwap_cross_count") and not c.startswith("opening_volume")]
    return out.select("user_id", "day", "session_volume", "vwap_cross_count", *r6s(*wide), *(F.round(c, 4).alias(c) for c in out.columns if c.startswith("opening_volume")))


@register("pit_universe", f"SELECT security_id, session_date, coalesce(pc >= 5 AND n >= 10 AND md >= 100, false) AS in_universe FROM (SELECT security_id, session_date, lag(close) OVER w AS pc, quantile_cont(dollar, 0.5) OVER p AS md, count(dollar) OVER p AS n FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY security_id ORDER BY session_date), p AS (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))")
def pit_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership from prior sessions only."""
    return P.universe(bars(spark, sf_dir), "security_id", "session_date", F.col("close"), F.col("dollar"), 5.0, 100.0, 20, 10).select("security_id", "session_date", "in_universe")


@register("split_consistent_view", f"SELECT security_id, session_date, round(close / CASE WHEN security_id % 3 = 0 THEN 2e0 ELSE 1e0 END, 6) AS research_close FROM ({BARS_SQL})")
def split_consistent_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices over the session's split factor."""
    b = bars(spark, sf_dir)
    factors = b.where("security_id % 3 = 0").select("security_id", "session_date", F.lit(2.0).alias("split_factor"))
    return P.split_consistent(b, factors, ["security_id", "session_date"], ["close"]).select("security_id", "session_date", r6("research_close", "research_close"))


_T = f"t AS (SELECT *, nullif(lead(open) OVER w, 0) AS entry, lead(session_date) OVER w AS entry_date, nullif(lead(market_open) OVER w, 0) AS m_entry, lead(close, 1) OVER w AS x1, lead(close, 3) OVER w AS x3, lead(market_close, 3) OVER w AS mx3, lead(session_date, 3) OVER w AS exit_date FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY security_id ORDER BY session_date))"


@register("targets_forward", f"WITH {_T} SELECT security_id, session_date, round(x1 / entry - 1, 6) + 0e0 AS target_1, round(x3 / entry - 1, 6) + 0e0 AS target_3 FROM t")
def targets_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3: entry at the next open, exit at the close of the held bar."""
    t = P.forward_targets(bars(spark, sf_dir), ["security_id"], ["session_date"], (1, 3))
    return t.select("security_id", "session_date", *r6s("target_1", "target_3"))


@register("targets_eod_overnight", "WITH e AS (SELECT user_id, event_id, ts, value, CAST(ts AS DATE) AS day FROM events), d AS (SELECT user_id, day, arg_max(value, ts) AS last, arg_min(value, ts) AS first FROM e GROUP BY ALL), n AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY day) AS next_open FROM d) SELECT event_id, round(last / nullif(value, 0) - 1, 6) + 0e0 AS to_close, round(next_open / nullif(value, 0) - 1, 6) + 0e0 AS overnight FROM e JOIN n USING (user_id, day)")
def targets_eod_overnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M4: to the session's last price, and to the next session's first."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    d = e.groupBy("user_id", "day").agg(F.max_by("value", "ts").alias("last"), F.min_by("value", "ts").alias("first"))
    d = d.withColumn("next_open", F.lead("first").over(Window.partitionBy("user_id").orderBy("day")))
    return e.join(d, ["user_id", "day"]).select("event_id", r6(F.try_divide("last", "value") - 1, "to_close"), r6(F.try_divide("next_open", "value") - 1, "overnight"))


_BETA = "b AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, market_close / nullif(lag(market_close) OVER w, 0) - 1 AS m FROM t WINDOW w AS (PARTITION BY security_id ORDER BY session_date)), k AS (SELECT *, CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER p >= 6 THEN covar_samp(r, m) OVER p / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER p, 0) END AS beta FROM b WINDOW p AS (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"


@register("targets_adjusted", f"WITH {_T}, {_BETA} SELECT security_id, session_date, round(beta, 5) AS beta, round((x3 / entry - 1) - (mx3 / m_entry - 1), 6) + 0e0 AS benchmark_adjusted, round((x3 / entry - 1) - beta * (mx3 / m_entry - 1), 5) + 0e0 AS beta_residual FROM k")
def targets_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7: less the market's, and less beta times it; a missing beta leaves the residual missing."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    b = bars(spark, sf_dir)
    b = P.forward_targets(P.forward_targets(b, ["security_id"], ["session_date"], (3,)).withColumnRenamed("target_3", "y"), ["security_id"], ["session_date"], (3,), "market_open", "market_close").withColumnRenamed("target_3", "ym")
    b = b.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("m", F.try_divide("market_close", F.lag("market_close").over(w)) - 1)
    b = b.withColumn("beta", P.beta(b, "security_id", "session_date", "r", "m", 12, 6))
    return b.select("security_id", "session_date", F.round("beta", 5).alias("beta"), r6(F.col("y") - F.col("ym"), "benchmark_adjusted"), (F.round(F.col("y") - F.col("beta") * F.col("ym"), 5) + F.lit(0.0)).alias("beta_residual"))


@register("targets_fail_closed", f"WITH {_T}, a AS (SELECT security_id, min(session_date) AS action_date FROM ({BARS_SQL}) WHERE open > 60 GROUP BY ALL), j AS (SELECT t.security_id, t.session_date, t.x3 / t.entry - 1 AS target, bool_or(a.action_date IS NOT NULL) AS crosses_action FROM t LEFT JOIN a ON a.security_id = t.security_id AND a.action_date > t.entry_date AND a.action_date <= t.exit_date GROUP BY ALL) SELECT security_id, session_date, crosses_action, round(CASE WHEN NOT crosses_action THEN target END, 6) + 0e0 AS target FROM j")
def targets_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that crosses a corporate action is missing."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    b = bars(spark, sf_dir)
    actions = b.where("open > 60").groupBy("security_id").agg(F.min("session_date").alias("action_date"))
    t = P.forward_targets(b, ["security_id"], ["session_date"], (3,)).select("security_id", "session_date", F.lead("session_date").over(w).alias("entry_date"), F.lead("session_date", 3).over(w).alias("exit_date"), F.col("target_3").alias("target"))
    return P.fail_closed(t, actions, "security_id", "entry_date", "exit_date", "target").select("security_id", "session_date", "crosses_action", r6("target", "target"))


@register("excursions", "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), p AS (SELECT a.event_id, b.rn - a.rn AS step, b.value / a.value - 1 AS ret FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn <= a.rn + 6 WHERE a.value <> 0) SELECT event_id, round(greatest(max(ret), 0), 6) + 0e0 AS mfe, round(least(min(ret), 0), 6) + 0e0 AS mae, arg_max(step, (ret, -step)) AS time_to_mfe, arg_min(step, (ret, step)) AS time_to_mae, round(arg_max(ret, step), 6) + 0e0 AS terminal, round(greatest(max(ret), 0) - arg_max(ret, step), 6) + 0e0 AS giveback, round(arg_max(ret, step) - least(min(ret), 0), 6) + 0e0 AS recovery, count(*) AS steps FROM p GROUP BY event_id")
def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst points of the next six rows; an entry price of zero has no path."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 6)
    e = table(spark, sf_dir, "events").select("event_id", "value", F.collect_list("value").over(w).alias("ahead")).where("value <> 0")
    p = e.select("event_id", "value", F.posexplode("ahead").alias("k", "x")).select("event_id", (F.col("k") + 1).cast("long").alias("step"), (F.col("x") / F.col("value") - 1).alias("ret"))
    return P.excursions(p, ["event_id"], "step", "ret").select("event_id", *r6s("mfe", "mae"), "time_to_mfe", "time_to_mae", *r6s("terminal", "giveback", "recovery"), "steps")


@register("target_ledger_pivot", f"WITH {_T}, l AS (SELECT security_id, session_date, 'h1' AS target_id, x1 / entry - 1 AS v FROM t UNION ALL SELECT security_id, session_date, 'h3', x3 / entry - 1 FROM t) SELECT security_id, session_date, round(max(v) FILTER (WHERE target_id = 'h1'), 6) + 0e0 AS h1, round(max(v) FILTER (WHERE target_id = 'h3'), 6) + 0e0 AS h3 FROM l GROUP BY ALL")
def target_ledger_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.1 ledger and aligned matrix, M10: long targets pivoted by id; the ids are given, so no pass looks for them."""
    t = P.forward_targets(bars(spark, sf_dir), ["security_id"], ["session_date"], (1, 3))
    long = t.select("security_id", "session_date", F.explode(F.create_map(F.lit("h1"), F.col("target_1"), F.lit("h3"), F.col("target_3"))).alias("target_id", "v"))
    return long.groupBy("security_id", "session_date").pivot("target_id", ["h1", "h3"]).agg(F.max("v")).select("security_id", "session_date", *r6s("h1", "h3"))


@register("observation_index", f"SELECT CAST(row_number() OVER (ORDER BY session_date, security_id) - 1 AS BIGINT) AS obs_id, security_id, session_date, CAST(dense_rank() OVER (ORDER BY session_date) - 1 AS BIGINT) AS session_id, CAST(row_number() OVER (PARTITION BY security_id ORDER BY session_date) - 1 AS BIGINT) AS seq FROM ({BARS_SQL})")
def observation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense observation ids without a global sort: a session's count stands before the next session's rows."""
    b = bars(spark, sf_dir).select("security_id", "session_date")
    d = b.groupBy("session_date").agg(F.count("*").alias("k"))
    w = Window.orderBy("session_date")  # one row a session
    d = d.select("session_date", F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.row_number().over(w) - 1).cast("long").alias("session_id"))
    own = Window.partitionBy("session_date").orderBy("security_id")
    return b.join(d, "session_date").select((F.col("before") + F.row_number().over(own) - 1).alias("obs_id"), "security_id", "session_date", "session_id", (F.row_number().over(Window.partitionBy("security_id").orderBy("session_date")) - 1).cast("long").alias("seq"))


@register("own_history_zscore", f"SELECT security_id, session_date, round(CASE WHEN count(close) OVER p >= 8 THEN (close - avg(close) OVER p) / nullif(stddev_samp(close) OVER p, 0) END, 5) + 0e0 AS z FROM ({BARS_SQL}) WINDOW p AS (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)")
def own_history_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K representations: a value against the security's own past."""
    p = Window.partitionBy("security_id").orderBy("session_date").rowsBetween(-12, -1)
    z = F.when(F.count("close").over(p) >= 8, (F.col("close") - F.avg("close").over(p)) / F.nullif(F.stddev_samp("close").over(p), F.lit(0.0)))
    return bars(spark, sf_dir).select("security_id", "session_date", (F.round(z, 5) + F.lit(0.0)).alias("z"))


@register("cross_section_ranks", f"SELECT security_id, session_date, round(r, 6) AS average_rank, round(r - 0.5e0 / n, 6) AS mid_rank FROM (SELECT security_id, session_date, (rank() OVER (PARTITION BY session_date ORDER BY close) + (count(*) OVER (PARTITION BY session_date, close) - 1) / 2e0) / count(*) OVER (PARTITION BY session_date) AS r, count(*) OVER (PARTITION BY session_date) AS n FROM ({BARS_SQL}))")
def cross_section_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile ranks of a decision."""
    return bars(spark, sf_dir).select("security_id", "session_date", r6(C.average_rank(F.col("close"), ["session_date"]), "average_rank"), r6(C.mid_rank(F.col("close"), ["session_date"]), "mid_rank"))


@register("session_history", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 60e6 AS t, value, 1e0 + event_id % 7 AS v FROM events), x AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, day) AS o FROM e),
s AS (SELECT user_id, day, arg_min(value, t) AS so, arg_max(value, t) AS sc, arg_max(value, t) FILTER (WHERE o <= 60) AS p60, arg_max(value, t) FILTER (WHERE o <= 240) AS p240, sum(v) FILTER (WHERE o <= 60) AS ov FROM x GROUP BY ALL),
h AS (SELECT *, lag(sc) OVER w AS pc, CASE WHEN count(ov) OVER p >= 3 THEN avg(ov) OVER p END AS mv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day), p AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT user_id, day, round(ov / nullif(mv, 0), 6) AS opening_rvol_60m, round(CASE WHEN so <> pc AND so <> 0 THEN greatest(-2, least(2, (so - p60) / (so - pc))) END, 6) + 0e0 AS gap_fill_fraction_60m, round(p240 / nullif(so, 0) - 1, 6) + 0e0 AS open_to_midday_return, round(CASE WHEN so <> 0 THEN sc / nullif(p240, 0) - 1 END, 6) + 0e0 AS midday_to_close_return FROM h""")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K session: opening volume against prior sessions, gap fills, the session's halves."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "value", (1.0 + F.col("event_id") % 7).alias("v"))
    m = P.session_metrics(e, ["user_id", "day"], "ts", "value", "v", (60, 240))
    w = Window.partitionBy("user_id").orderBy("day")
    p = w.rowsBetween(-5, -1)
    m = m.withColumn("pc", F.lag("session_close").over(w)).withColumn("mv", F.when(F.count("opening_volume_60m").over(p) >= 3, F.avg("opening_volume_60m").over(p)))
    fill = -F.col("opening_return_60m") * F.col("session_open") / F.nullif(F.col("session_open") - F.col("pc"), F.lit(0.0))
    fill = F.when(fill > 2, 2.0).when(fill < -2, -2.0).otherwise(fill)
    mid = F.col("opening_return_240m")
    return m.select("user_id", "day", r6(F.try_divide("opening_volume_60m", "mv"), "opening_rvol_60m"), r6(fill, "gap_fill_fraction_60m"), r6(mid, "open_to_midday_return"), r6(F.try_divide(F.col("session_close"), F.col("session_open") * (1 + mid)) - 1, "midday_to_close_return"))


@register("same_bucket_features", """WITH h AS (SELECT user_id % 5 AS k, extract(hour FROM ts) // 4 AS bucket, CAST(ts AS DATE) AS day, avg(value) AS v, sum(value) AS vol FROM events GROUP BY ALL), r AS (SELECT *, (rank() OVER (PARTITION BY day, bucket ORDER BY v) + (count(*) OVER (PARTITION BY day, bucket, v) - 1) / 2e0) / count(*) OVER (PARTITION BY day, bucket) AS rk FROM h)
SELECT k, CAST(bucket AS INTEGER) AS bucket, day, round(CASE WHEN count(vol) OVER p >= 4 THEN vol / nullif(avg(vol) OVER p, 0) END, 6) AS same_bucket_rvol, round(CASE WHEN count(v) OVER p >= 4 THEN stddev_samp(v) OVER p END, 6) AS same_bucket_volatility, round(CASE WHEN count(rk) OVER p >= 4 THEN avg(rk) OVER p END, 7) AS same_bucket_return_rank FROM r WINDOW p AS (PARTITION BY k, bucket ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""")
def same_bucket_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K same_time: volume, deviation and cross-sectional rank against the same clock bucket of prior sessions."""
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("k"), F.floor(F.hour("ts") / 4).cast("int").alias("bucket"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.sum("value").alias("vol"))
    h = h.withColumn("rk", C.average_rank(F.col("v"), ["day", "bucket"]))
    p = Window.partitionBy("k", "bucket").orderBy("day").rowsBetween(-8, -1)
    enough = lambda c, x: F.when(F.count(c).over(p) >= 4, x)
    return h.select("k", "bucket", "day", r6(enough("vol", F.try_divide("vol", F.avg("vol").over(p))), "same_bucket_rvol"), r6(enough("v", F.stddev_samp("v").over(p)), "same_bucket_volatility"), F.round(enough("rk", F.avg("rk").over(p)), 7).alias("same_bucket_return_rank"))
