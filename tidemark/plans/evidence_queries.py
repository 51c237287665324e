"""Forensics, execution, evidence service, learning and stateful queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import execution as X
from tidemark.operators import forensics as R
from tidemark.operators import panel as P
from tidemark.functions.sqltext import SPARK
from tidemark.plans import staged
from tidemark.plans.clock_queries import grid
from tidemark.plans.panel_queries import _T, r6s
from tidemark.plans.surface_queries import r6
from tidemark.sources.tables import BARS_SQL, bars, table

_RET = "WITH e AS (SELECT event_id, user_id, event_type, ts, value, value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1 AS y FROM events)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("y", F.try_divide("value", F.lag("value").over(w)) - 1)


@register("distribution_stats", _RET + " SELECT event_type, count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(avg(CASE WHEN y > 0 THEN 1e0 WHEN y IS NOT NULL THEN 0e0 END), 6) AS win_rate, round(avg(y) FILTER (WHERE y > 0), 6) AS average_win, round(avg(y) FILTER (WHERE y < 0), 6) AS average_loss, " + ", ".join(f"round(quantile_cont(y, {q}), 6) + 0e0 AS p{round(100 * q):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM e WHERE y IS NOT NULL GROUP BY event_type")
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: moments, win rate and quantiles."""
    out = R.distribution(returns(spark, sf_dir), "y", ["event_type"])
    return out.select("event_type", "n", *r6s(*(c for c in out.columns if c not in ("event_type", "n"))))


@register("contribution_concentration", _RET + ", r AS (SELECT y, row_number() OVER (ORDER BY y DESC, event_id) AS r, count(*) OVER () AS n, sum(y) OVER () AS t FROM e WHERE y IS NOT NULL) SELECT round(sum(y) FILTER (WHERE r <= ceil(n * 0.01e0)) / nullif(any_value(t), 0), 6) AS top1, round(sum(y) FILTER (WHERE r <= ceil(n * 0.05e0)) / nullif(any_value(t), 0), 6) AS top5 FROM r")
def contribution_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: what the largest percent of rows holds of the total."""
    return R.concentration(returns(spark, sf_dir), "y", "event_id").select(*r6s("top1", "top5"))


@register("interaction_decomposition", "SELECT round(avg(l_tax) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) - (avg(l_tax) FILTER (WHERE l_quantity > 25) + avg(l_tax) FILTER (WHERE l_discount > 0.05) - avg(l_tax)), 8) + 0e0 AS interaction, count(*) FILTER (WHERE l_quantity > 25 AND l_discount > 0.05) AS joint_n FROM lineitem")
def interaction_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint mean less what both parts explain."""
    a, b, y = F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax")
    x = F.avg(F.when(a & b, y)) - (F.avg(F.when(a, y)) + F.avg(F.when(b, y)) - F.avg(y))
    return table(spark, sf_dir, "lineitem").agg((F.round(x, 8) + F.lit(0.0)).alias("interaction"), F.count_if(a & b).alias("joint_n"))


@register("timing_concurrency", "WITH s AS (SELECT event_id, ts AS a, ts + INTERVAL 90 MINUTE AS b FROM events WHERE event_type = 'purchase'), d AS (SELECT t, sum(d) AS d FROM (SELECT a AS t, 1 AS d FROM s UNION ALL SELECT b, -1 FROM s) GROUP BY t), r AS (SELECT sum(d) OVER (ORDER BY t) AS open FROM d) SELECT CAST(max(open) AS BIGINT) AS most_open, (SELECT count(*) FROM (SELECT a FROM s GROUP BY a HAVING count(*) > 1)) AS simultaneous, CAST(count(*) AS BIGINT) AS moments FROM r")
def timing_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simultaneous starts and the most that are open at once."""
    s = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("ts", (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("stop"))
    same = s.groupBy("ts").count().where("count > 1").agg(F.count("*").alias("simultaneous"))
    return R.concurrency(s, "ts", "stop").agg(F.max("open").cast("long").alias("most_open"), F.count("*").alias("moments")).crossJoin(same).select("most_open", "simultaneous", "moments")


@register("signal_jaccard", "SELECT count(*) FILTER (WHERE l_quantity > 40 AND l_discount > 0.08) AS both, count(*) FILTER (WHERE l_quantity > 40 OR l_discount > 0.08) AS either, round(count(*) FILTER (WHERE l_quantity > 40 AND l_discount > 0.08) / nullif(count(*) FILTER (WHERE l_quantity > 40 OR l_discount > 0.08), 0), 8) AS jaccard FROM lineitem")
def signal_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two signals."""
    a, b = F.col("l_quantity") > 40, F.col("l_discount") > 0.08
    return table(spark, sf_dir, "lineitem").agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"), F.round(F.try_divide(F.count_if(a & b), F.count_if(a | b)), 8).alias("jaccard"))


@register("crossfit_cells", "WITH c AS (SELECT CAST(floor(l_quantity / 10.0001) AS INTEGER) AS cell, CAST(extract(year FROM l_shipdate) % 3 AS INTEGER) AS fold, count(*) AS n, sum(l_tax) AS s FROM lineitem GROUP BY ALL), t AS (SELECT a.fold, a.cell, a.n, a.s, sum(b.n) AS nt, sum(b.s) AS st FROM c a JOIN c b ON a.cell = b.cell AND b.fold <> a.fold GROUP BY ALL) SELECT fold, cell, n AS held_n, round(s / n, 8) AS held_mean, round(st / nt, 8) AS train_mean FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(st / nt, 10) DESC, cell) = 1")
def crossfit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell chosen on the other folds, judged on the one held out; training sums are totals less the fold."""
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10.0001).cast("int").alias("cell"), (F.year("l_shipdate") % 3).alias("fold"), "l_tax")
    c = li.groupBy("cell", "fold").agg(F.count("*").alias("n"), F.sum("l_tax").alias("s"))
    w = Window.partitionBy("cell")
    c = c.withColumn("nt", F.sum("n").over(w) - F.col("n")).withColumn("st", F.sum("s").over(w) - F.col("s")).withColumn("train", F.col("st") / F.col("nt"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.round("train", 10).desc(), "cell"))).where("r = 1")
    return c.select("fold", "cell", F.col("n").alias("held_n"), F.round(F.col("s") / F.col("n"), 8).alias("held_mean"), F.round("train", 8).alias("train_mean"))


@register("leave_out_views", _RET + ", m AS (SELECT user_id, sum(y) AS s, count(y) AS n FROM e GROUP BY ALL), b AS (SELECT user_id FROM m ORDER BY round(s, 8) DESC, user_id LIMIT 1), q AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM e) SELECT round(avg(y), 6) AS everything, round(avg(y) FILTER (WHERE user_id NOT IN (SELECT user_id FROM b)), 6) AS without_best, round(avg(greatest(least(y, q.hi), q.lo)), 6) AS winsorised FROM e, q WHERE y IS NOT NULL")
def leave_out_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean without its best symbol, and winsorised."""
    e = returns(spark, sf_dir).where("y IS NOT NULL")
    best = e.groupBy("user_id").agg(F.sum("y").alias("s")).orderBy(F.round("s", 8).desc(), "user_id").limit(1).select(F.col("user_id").alias("best"))
    q = e.agg(F.percentile("y", F.lit(0.01)).alias("lo"), F.percentile("y", F.lit(0.99)).alias("hi"))
    x = e.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(q))
    return x.agg(r6(F.avg("y"), "everything"), r6(F.avg(F.when(F.col("user_id") != F.col("best"), F.col("y"))), "without_best"), r6(F.avg(F.greatest(F.least("y", "hi"), "lo")), "winsorised"))


@register("effect_decay", f"WITH {_T} SELECT round(corr(close, x1 / entry - 1), 5) AS corr_1, round(corr(close, x3 / entry - 1), 5) AS corr_3, count(*) AS n FROM t WHERE x3 / entry IS NOT NULL")
def effect_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association with targets of growing horizon."""
    t = P.forward_targets(bars(spark, sf_dir), ["security_id"], ["session_date"], (1, 3)).where("target_3 IS NOT NULL")
    return t.agg(F.round(F.corr("close", "target_1"), 5).alias("corr_1"), F.round(F.corr("close", "target_3"), 5).alias("corr_3"), F.count("*").alias("n"))


@register("threshold_curve", " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS fraction, count(*) AS n FROM events WHERE value >= (SELECT quantile_cont(value, {1 - f!r}) FROM events)" for f in (0.2, 0.1, 0.05, 0.02, 0.01)))
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of tails from one pass of quantiles."""
    e = table(spark, sf_dir, "events")
    f = [0.2, 0.1, 0.05, 0.02, 0.01]
    q = e.agg(*(F.percentile("value", F.lit(1 - x)).alias(f"q{k}") for k, x in enumerate(f)))
    n = e.crossJoin(F.broadcast(q)).agg(*(F.count_if(F.col("value") >= F.col(f"q{k}")).alias(f"n{k}") for k in range(len(f))))
    return n.select(F.explode(F.array(*(F.struct(F.lit(x).alias("fraction"), F.col(f"n{k}").alias("n")) for k, x in enumerate(f)))).alias("x")).select("x.*")


@register("persistence_turnover", f"WITH x AS (SELECT security_id, close, lag(close) OVER w AS p, CASE WHEN close > 20 THEN 1e0 ELSE 0e0 END AS s, lag(CASE WHEN close > 20 THEN 1e0 ELSE 0e0 END) OVER w AS sp FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY security_id ORDER BY session_date)) SELECT round(corr(close, p), 6) AS persistence, round(avg(abs(s - sp)), 6) AS turnover FROM x")
def persistence_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a state lasts, and how often it changes."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    s = F.when(F.col("close") > 20, 1.0).otherwise(0.0)
    x = bars(spark, sf_dir).select("close", F.lag("close").over(w).alias("p"), s.alias("s"), F.lag(s).over(w).alias("sp"))
    return x.agg(r6(F.corr("close", "p"), "persistence"), r6(F.avg(F.abs(F.col("s") - F.col("sp"))), "turnover"))


@register("cost_capacity_curves", _RET + ", c AS (SELECT unnest([0, 5, 10, 20]) AS bps), k AS (SELECT unnest([10, 100, 1000]) AS cap) SELECT 'cost' AS curve, CAST(bps AS BIGINT) AS level, round(avg(y - bps / 1e4), 6) AS v FROM e, c GROUP BY bps UNION ALL SELECT 'capacity', CAST(cap AS BIGINT), round(avg(least(value, cap)), 6) FROM e, k GROUP BY cap")
def cost_capacity_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net effect by cost, fillable size by cap. Each level is a column of one pass."""
    e = returns(spark, sf_dir)
    cost, cap = [0, 5, 10, 20], [10, 100, 1000]
    one = e.agg(*(F.avg(F.col("y") - b / 1e4).alias(f"c{b}") for b in cost), *(F.avg(F.least(F.col("value"), F.lit(float(b)))).alias(f"k{b}") for b in cap))
    rows = [F.struct(F.lit(n).alias("curve"), F.lit(b).cast("long").alias("level"), r6(f"{p}{b}").alias("v")) for n, p, levels in (("cost", "c", cost), ("capacity", "k", cap)) for b in levels]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


@register("grouped_effects", _RET + " SELECT kind, label, count(y) AS n, round(avg(y), 6) AS mean FROM (SELECT 'type' AS kind, event_type AS label, y FROM e UNION ALL SELECT 'weekday', CAST(isodow(ts) AS VARCHAR), y FROM e) GROUP BY ALL")
def grouped_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects by several groupings in one pass."""
    x = returns(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("event_type").alias("label")), F.struct(F.lit("weekday").alias("kind"), (F.weekday("ts") + 1).cast("string").alias("label")))).alias("g"), "y")
    return x.groupBy("g.kind", "g.label").agg(F.count("y").alias("n"), r6(F.avg("y"), "mean"))


@register("factor_attribution", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem")
def factor_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares by sums."""
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.count("*").alias("n"))


@register("variant_audit", f"WITH x AS (SELECT round(close - open, 9) AS a, round(close - vwap, 9) AS b FROM ({BARS_SQL})), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM x WHERE a IS NOT NULL AND b IS NOT NULL) SELECT round(corr(ra, rb), 6) AS rank_corr, round(avg(CASE WHEN sign(a) = sign(b) THEN 1e0 ELSE 0e0 END), 6) AS sign_agreement FROM r")
def variant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike two variants of a feature are: rank correlation, and agreement in sign."""
    # rounded, since the lowest bits of a mean depend on the order of its sum and would break ties
    x = bars(spark, sf_dir).select(F.round(F.col("close") - F.col("open"), 9).alias("a"), F.round(F.col("close") - F.col("vwap"), 9).alias("b"))
    agree = x.where("a IS NOT NULL AND b IS NOT NULL").agg(r6(F.avg((F.signum("a") == F.signum("b")).cast("double")), "sign_agreement"))
    return R.spearman(x, "a", "b").select(r6("rho", "rank_corr")).crossJoin(agree)


@register("placebo_test")
def placebo_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals dealt anew within a decision by a seeded hash, 20 times; p = (1 + k) / (R + 1). Random by nature: no SQL twin."""
    li = table(spark, sf_dir, "lineitem").withColumn("signal", (F.col("l_quantity") > 25).cast("int"))
    return R.placebo(li, "l_shipdate", ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"], "signal", "l_tax", 20)


_GREEDY = "WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events), g AS (SELECT user_id, 1::BIGINT AS position FROM e GROUP BY user_id UNION ALL SELECT user_id, position + 4 FROM g WHERE position + 4 <= (SELECT max(position) FROM e x WHERE x.user_id = g.user_id)) SELECT e.user_id, e.event_id, e.position FROM e JOIN g ON e.user_id = g.user_id AND e.position = g.position"


@register("independent_entries", _GREEDY)
def independent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries at least four positions apart, admitted in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("position"))
    return R.admitted(e, ["user_id"], ["position"], 4)


@register("capital_capped")
def capital_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals admitted while a slot is free; checked against a replay in the tests."""
    s = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("start"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).cast("timestamp").alias("stop"))
    return R.capped(s, 5).select("signal_id", "admitted")


@register("replay_one_position")
def replay_one_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open position a security, with a status for every signal; checked against a replay in the tests."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("signal_id"), F.col("ts").cast("timestamp").alias("entry_ts"), F.lead(F.col("ts").cast("timestamp"), 3).over(w).alias("exit_ts"), F.col("value").alias("entry_price"), F.lead("value", 3).over(w).alias("exit_price"))
    out = X.one_position(s, "user_id")
    return out.select("user_id", "signal_id", "status", r6(X.leg_return(F.col("entry_price"), F.col("exit_price"), F.lit(1.0)) - X.friction(2.0, 2.0, 0.0, F.lit(1.0), F.lit(1.0)), "net"))


@register("drawdown_curve", _RET + ", q AS (SELECT user_id, event_id, sum(y) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS equity, ts FROM e WHERE y IS NOT NULL) SELECT event_id, round(equity, 6) + 0e0 AS equity, round(equity - greatest(max(equity) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) + 0e0 AS drawdown FROM q")
def drawdown_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity and drawdown in exit order."""
    return X.drawdown(returns(spark, sf_dir).where("y IS NOT NULL"), ["ts", "event_id"], "y", ["user_id"]).select("event_id", r6("equity", "equity"), r6("drawdown", "drawdown"))


@register("marketable_fills", "SELECT a.event_id, round(least(a.quantity, floor(b.ask_size * 0.25)), 6) AS filled, CASE WHEN least(a.quantity, floor(b.ask_size * 0.25)) > 0 THEN round(b.ask, 6) END AS price FROM (SELECT event_id, user_id, ts, CAST(5 AS DOUBLE) AS quantity FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, value AS ask, value * 2 AS ask_size FROM events WHERE value > 4) b ON a.user_id = b.user_id AND a.ts <= b.ts")
def marketable_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill at the first valid quote, capped by its size."""
    e = table(spark, sf_dir, "events")
    orders = e.where("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("order_ts"), F.lit(5.0).alias("quantity"))
    quotes = e.where("value > 4").select("user_id", F.col("ts").alias("quote_ts"), F.col("value").alias("ask"), (F.col("value") - 1).alias("bid"), (F.col("value") * 2).alias("ask_size"))
    return X.marketable_fill(orders, quotes, ["user_id"], 0.25).select("event_id", r6("filled", "filled"), r6("price", "price"))


@register("passive_fills", "SELECT a.event_id AS order_id, min(b.ts) AS fill_ts FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 24 HOUR AND b.value < a.value * 0.9e0 WHERE a.event_type = 'click' GROUP BY a.event_id")
def passive_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting orders that a later trade goes through."""
    e = table(spark, sf_dir, "events")
    orders = e.where("event_type = 'click'").select(F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("order_ts"), (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expires"), (F.col("value") * 0.9).alias("limit_price"))
    trades = e.select("user_id", F.col("ts").alias("trade_ts"), F.col("value").alias("price"))
    return X.passive_fill(orders, trades, ["user_id"], 86400.0).select("order_id", "fill_ts")


@register("trade_summary", _RET + ", d AS (SELECT CAST(ts AS DATE) AS day, sum(y) AS d, count(y) AS n, count(*) FILTER (WHERE y > 0) AS w FROM e WHERE y IS NOT NULL GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS trades, round(sum(d) / sum(n), 6) AS mean, round(sum(w) / sum(n), 6) AS win_rate, round(avg(d) / stddev_samp(d) * sqrt(252e0), 5) AS sharpe FROM d")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: summary with the daily Sharpe ratio."""
    out = X.summary(returns(spark, sf_dir).where("y IS NOT NULL").withColumn("day", F.to_date("ts")), "day", "y")
    return out.select("trades", r6("mean", "mean"), r6("win_rate", "win_rate"), F.round("sharpe", 5).alias("sharpe"))


@register("walk_forward_folds", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), f AS (SELECT day, CAST(ntile(4) OVER (ORDER BY day) AS INTEGER) AS fold, row_number() OVER (ORDER BY day) AS k FROM d), b AS (SELECT fold, min(k) AS first_k FROM f GROUP BY fold) SELECT b.fold, count(*) FILTER (WHERE f.fold = b.fold) AS test_days, count(*) FILTER (WHERE f.k < b.first_k - 2) AS train_days FROM f, b WHERE b.fold > 1 GROUP BY b.fold")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds with an embargo of two days before each test."""
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    w = Window.orderBy("day")
    f = d.select("day", F.ntile(4).over(w).alias("fold"), F.row_number().over(w).alias("k"))
    b = f.groupBy("fold").agg(F.min("k").alias("first_k")).where("fold > 1").select(F.col("fold").alias("test"), "first_k")
    return f.crossJoin(F.broadcast(b)).groupBy(F.col("test").alias("fold")).agg(F.count_if(F.col("fold") == F.col("test")).alias("test_days"), F.count_if(F.col("k") < F.col("first_k") - 2).alias("train_days"))


@register("training_selection", "SELECT feature, round(abs(c), 6) AS score FROM (SELECT 'quantity' AS feature, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL SELECT 'tax', corr(l_tax, l_extendedprice) FROM lineitem) ORDER BY abs(c) DESC, feature LIMIT 2")
def training_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by absolute correlation, all from one pass."""
    names = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}
    one = table(spark, sf_dir, "lineitem").agg(*(F.abs(F.corr(c, "l_extendedprice")).alias(n) for n, c in names.items()))
    long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("score")) for n in names))).alias("x")).select("x.*")
    return long.orderBy(F.desc("score"), "feature").limit(2).select("feature", r6("score", "score"))


@register("ridge_model")
def ridge_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regressor with mean imputation, judged out of fold. Iterative fit: no SQL twin."""
    from tidemark.operators.learning import out_of_fold

    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"), (F.year("l_shipdate") % 3).alias("fold"))
    return out_of_fold(li, ["l_quantity", "l_discount", "l_tax"], "y", "fold")


@register("specific_return", f"SELECT security_id, session_date, round((close / nullif(open, 0) - 1 - avg(close / nullif(open, 0) - 1) OVER d) / nullif(stddev_samp(close / nullif(open, 0) - 1) OVER d, 0), 5) + 0e0 AS z FROM ({BARS_SQL}) WINDOW d AS (PARTITION BY session_date)")
def specific_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return against the session's cross-section, in deviations."""
    d = Window.partitionBy("session_date")
    r = F.try_divide("close", "open") - 1
    return bars(spark, sf_dir).select("security_id", "session_date", (F.round((r - F.avg(r).over(d)) / F.nullif(F.stddev_samp(r).over(d), F.lit(0.0)), 5) + F.lit(0.0)).alias("z"))


@register("event_path", "WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT CAST(b.rn - a.rn AS BIGINT) AS step, count(*) AS n, round(avg(b.value / nullif(a.value, 0) - 1), 6) AS mean FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn - a.rn BETWEEN -2 AND 3 WHERE a.event_type = 'purchase' GROUP BY ALL")
def event_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean path around events, from one window of each row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = range(-2, 4)
    e = table(spark, sf_dir, "events").select("event_type", "value", *((F.lead("value", k) if k > 0 else F.lag("value", -k) if k < 0 else F.col("value")).over(w).alias(f"v{k + 2}") if k else F.col("value").alias("v2") for k in steps)).where("event_type = 'purchase'")
    long = e.select("value", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("step"), F.col(f"v{k + 2}").alias("v")) for k in steps))).alias("x")).where("x.v IS NOT NULL")
    return long.groupBy("x.step").agg(F.count("*").alias("n"), r6(F.avg(F.try_divide("x.v", "value") - 1), "mean"))


@register("factor_peer_block")
def factor_peer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L 71-90: factor residuals and peer features of a session, fitted on prior sessions; checked against a direct computation in the tests."""
    from tidemark.operators.clock import Pack
    from tidemark.operators.factors import peer_block
    from tidemark.plans.clock_queries import SHORT

    pack = Pack(SPARK, hist=8, beta_sessions=6, beta_least=40, **SHORT)
    return peer_block(staged.apply(grid(spark, sf_dir), pack.liquidity_stages()), pack, sessions=8, k=2, peers=3, least_sessions=8, least_rows=20)


@register("subgroup_query", "SELECT CAST(least(floor(k * 5), 4) AS INTEGER) AS cell, count(*) AS n, round(avg(y), 4) AS mean FROM (SELECT value AS y, CAST(ts AS DATE) AS d, (rank() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value) + (count(*) OVER (PARTITION BY CAST(ts AS DATE), value) - 1) / 2e0) / count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS k FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1 HAVING cell > 0 ORDER BY cell LIMIT 3")
def subgroup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: an exact subgroup query with a cursor: cells after a key, so many at a time."""
    from tidemark.operators.service import Query, answer

    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("decision"), F.col("value").alias("feature"), F.col("value").alias("y"))
    return answer(e, Query(bins=5, where={"event_type": ["click", "purchase"]}, page=3), after=0).select("cell", "n", F.round("mean", 4).alias("mean"))


@register("tumbling_stream", "SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.I: windowed sums; the same function serves a stream with a watermark."""
    from tidemark.streaming.windows import tumbling

    out = tumbling(table(spark, sf_dir, "events"), "6 hours")
    return out.select((F.unix_timestamp(F.col("window.start").cast("timestamp")) / 21600).cast("long").alias("slot"), "event_type", "n", F.round("total", 4).alias("total"))
