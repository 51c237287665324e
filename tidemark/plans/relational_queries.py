"""Scans, predicates, joins, windows, sorts, set operations and scalar functions as the engine uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import columns as C
from tidemark.operators import joins as J
from tidemark.plans.surface_queries import r6
from tidemark.sources.tables import placed, table


@register("latest_version", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key, as an aggregate that combines before the shuffle (no sort of a key's rows)."""
    e = table(spark, sf_dir, "events")
    newest = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("x"))
    return newest.select("user_id", "event_type", "x.event_id", r6("x.value", "value"))


@register("gated_read", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus = 'F'")
def gated_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and period are fixed before the scan, and reach it."""
    from tidemark.sources.readers import Gate, gated

    gate = Gate({"discovery": ("1996-01-01", "1996-12-31")})
    return gated(table(spark, sf_dir, "orders"), gate, "discovery", "o_orderdate", ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F").select("o_orderkey", r6("o_totalprice", "o_totalprice"))


@register("snapshot_contract", "SELECT count(*) AS rows, count(DISTINCT event_id) AS keys, count(*) - count(DISTINCT event_id) AS duplicates, count(*) FILTER (WHERE value IS NULL OR NOT isfinite(value)) AS not_finite, count(*) FILTER (WHERE ts IS NULL) AS without_time FROM events")
def snapshot_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's contract as one aggregate."""
    from tidemark.sources.readers import contract

    return contract(table(spark, sf_dir, "events"), ["event_id"], "ts", "value")


@register("key_set_difference", "(SELECT 'left' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT 'right', o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def key_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, C14, 2.G: keys of either side that the other lacks, by anti joins."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return c.join(o, "key", "left_anti").select(F.lit("left").alias("side"), "key").unionByName(o.join(c, "key", "left_anti").select(F.lit("right").alias("side"), "key"))


@register("session_mask", "SELECT event_id, CAST(extract(hour FROM l) * 60 + extract(minute FROM l) AS INTEGER) AS minute FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events) WHERE extract(hour FROM l) * 60 + extract(minute FROM l) >= 570 AND extract(hour FROM l) * 60 + extract(minute FROM l) < 960 AND extract(minute FROM l) % 5 = 0")
def session_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular session by local clock, on the five-minute grid."""
    local = F.from_utc_timestamp("ts", "America/New_York")
    e = table(spark, sf_dir, "events").select("event_id", (F.hour(local) * 60 + F.minute(local)).cast("int").alias("minute"), F.minute(local).alias("m"))
    return e.where("minute >= 570 AND minute < 960 AND m % 5 = 0").select("event_id", "minute")


@register("daily_close_emit", "WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, event_id, ts FROM events), b AS (SELECT day, max(ts) AS last FROM e WHERE user_id % 10 = 0 GROUP BY day) SELECT e.day, e.user_id, max(e.event_id) AS event_id FROM e JOIN b ON e.day = b.day AND e.ts <= b.last GROUP BY ALL")
def daily_close_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the benchmark's last time of a session."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_id", "ts")
    b = e.where("user_id % 10 = 0").groupBy("day").agg(F.max("ts").alias("last"))
    return e.join(b, "day").where("ts <= last").groupBy("day", "user_id").agg(F.max("event_id").alias("event_id"))


@register("symbol_filter", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 7) OR l_suppkey IN (SELECT min(s_suppkey) FROM supplier) GROUP BY ALL")
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6, C13, 2.G: a deterministic first-n list and a benchmark, as a semi join."""
    s = table(spark, sf_dir, "supplier")
    keys = s.orderBy("s_name", "s_suppkey").limit(7).select("s_suppkey").union(s.agg(F.min("s_suppkey"))).distinct()
    li = table(spark, sf_dir, "lineitem").select("l_suppkey")
    return li.join(keys, li.l_suppkey == keys.s_suppkey, "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@register("conditional_projection", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class, coalesce(nullif(p_size, 1), -1) AS not_one, greatest(p_size, 20) AS at_least, least(p_size, 20) AS at_most FROM part")
def conditional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional columns."""
    s = F.col("p_size")
    return table(spark, sf_dir, "part").drop("p_name").select("p_partkey", F.when(s < 10, "small").when(s < 30, "middle").otherwise("large").alias("size_class"), F.coalesce(F.nullif(s, F.lit(1)), F.lit(-1)).alias("not_one"), F.greatest(s, F.lit(20)).alias("at_least"), F.least(s, F.lit(20)).alias("at_most"))


@register("finite_filter", "SELECT event_id, round(value / nullif(event_id % 3, 0), 6) AS ratio FROM events WHERE event_id % 3 <> 0")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-finite values are missing."""
    e = table(spark, sf_dir, "events").withColumn("ratio", C.finite(F.try_divide("value", (F.col("event_id") % 3).cast("double"))))
    return e.where("ratio IS NOT NULL").select("event_id", r6("ratio", "ratio"))


@register("state_predicate", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_retailprice IS NOT NULL AND isfinite(p_retailprice) THEN CASE WHEN k <= 0.05e0 THEN 0 WHEN k >= 0.95e0 THEN 1 ELSE -1 END ELSE -1 END AS state FROM (SELECT p_retailprice, (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2e0 - 0.5e0) / count(*) OVER () AS k FROM part)) GROUP BY state")
def state_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail states of a mid-rank; everything else is -1."""
    p = table(spark, sf_dir, "part").where("p_retailprice IS NOT NULL").groupBy("p_retailprice").agg(F.count("*").alias("k"))
    n = p.agg(F.sum("k").alias("n"))
    x = C.sum_before(p, "p_retailprice", F.col("k")).crossJoin(F.broadcast(n)).withColumn("rank", (F.col("before") + F.col("k") / 2) / F.col("n"))
    return x.select(F.when(F.col("rank") <= 0.05, 0).when(F.col("rank") >= 0.95, 1).otherwise(-1).alias("state"), "k").groupBy("state").agg(F.sum("k").alias("n"))


@register("cell_membership", "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands FROM part WHERE p_size IN (1, 5, 9) OR p_brand IN ('Brand#11', 'Brand#22')")
def cell_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of listed cells."""
    return table(spark, sf_dir, "part").where(F.col("p_size").isin(1, 5, 9) | F.col("p_brand").isin("Brand#11", "Brand#22")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@register("inner_left_joins", "SELECT o_orderpriority, c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def inner_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi joins; which side is broadcast is left to measured sizes."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").groupBy("o_orderpriority", "c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("asof_strict", "SELECT a.event_id, b.event_id AS prior_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts")
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row strictly before each row."""
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("prior_id"))
    return J.asof(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", ["prior_id"], strict=True).select("event_id", "prior_id")


@register("asof_last_valid", "SELECT a.event_id, b.event_id AS quote_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE value > 20) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_last_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity is filtered before the search backward."""
    e = table(spark, sf_dir, "events")
    right = e.where("value > 20").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("quote_id"))
    return J.asof(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", ["quote_id"]).select("event_id", "quote_id")


@register("asof_forward", "SELECT a.event_id, b.event_id AS next_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts < b.ts")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row strictly after each row."""
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("next_id"))
    return J.asof(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", ["next_id"], strict=True, forward=True).select("event_id", "next_id")


@register("asof_tolerance", "SELECT event_id, next_id FROM (SELECT a.event_id, b.event_id AS next_id, b.ts AS hit_at, a.ts FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE value > 20) b ON a.user_id = b.user_id AND a.ts <= b.ts) WHERE hit_at < ts + INTERVAL 6 HOUR")
def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid row within a wait."""
    e = table(spark, sf_dir, "events")
    right = e.where("value > 20").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("next_id"))
    return J.asof(e.select("event_id", "user_id", "ts"), right.withColumn("hit_at", F.col("at")), ["user_id"], "ts", "at", ["next_id", "hit_at"], forward=True).where("hit_at < ts + INTERVAL 6 HOURS").select("event_id", "next_id")


@register("range_join", "SELECT a.event_id, count(b.event_id) AS n, round(max(b.value), 6) AS highest FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 12 HOUR WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within [entry, exit), through buckets of the interval."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("entry"))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    lo = F.unix_micros(F.col("entry").cast("timestamp")) / 1e6
    out = J.bucketed_range(a, e.select("user_id", "event_id", "value", "ts"), ["user_id"], lo, lo + 43200.0, t, 43200.0)
    return out.groupBy(F.col("id").alias("event_id")).agg(F.count("event_id").alias("n"), r6(F.max("value"), "highest"))


@register("delay_join", "SELECT a.event_id, d.delay, arg_min(b.value, b.ts) AS price FROM events a, (SELECT unnest([0, 60, 240]) AS delay) d, events b WHERE a.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts >= a.ts + to_minutes(d.delay) AND b.ts < a.ts + to_minutes(d.delay + 360) GROUP BY a.event_id, d.delay")
def delay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first price of each delayed band."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("entry"), F.explode(F.array(F.lit(0), F.lit(60), F.lit(240))).alias("delay"))
    lo = F.unix_micros(F.col("entry").cast("timestamp")) / 1e6 + F.col("delay") * 60.0
    out = J.bucketed_range(a, e.select("user_id", "value", "ts"), ["user_id"], lo, lo + 21600.0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 21600.0)
    return out.groupBy(F.col("id").alias("event_id"), "delay").agg(F.min_by("value", "ts").alias("price"))


@register("offset_self_join", "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT a.event_id, b.event_id AS exit_id, round(b.value / nullif(a.value, 0) - 1, 6) + 0e0 AS ret FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn = a.rn + 3")
def offset_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row three further on, without a self-join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lead("event_id", 3).over(w).alias("exit_id"), F.lead("value", 3).over(w).alias("x"))
    return e.where("exit_id IS NOT NULL").select("event_id", "exit_id", r6(F.try_divide("x", "value") - 1, "ret"))


@register("coverage_semi_join", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate <= o.o_orderdate + INTERVAL 10 DAY AND l.l_shipdate >= o.o_orderdate)")
def coverage_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that an interval covers."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, (li.l_orderkey == o.o_orderkey) & (li.l_shipdate <= o.o_orderdate + F.expr("INTERVAL 10 DAYS")) & (li.l_shipdate >= o.o_orderdate), "left_semi").select("o_orderkey")


@register("evidence_three_way", "WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS k, max(l_quantity) AS hi FROM lineitem GROUP BY ALL), c AS (SELECT s_suppkey AS k, s_nationkey FROM supplier) SELECT k, n, hi, s_nationkey FROM a JOIN b USING (k) JOIN c USING (k)")
def evidence_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of one key joined; those of one table are one aggregation."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("hi"))
    return li.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey"), "k")


@register("filtered_aggregates", "SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, bool_or(l_discount > 0.09) AS any_deep, CAST(count_if(l_tax = 0) AS BIGINT) AS untaxed, count(DISTINCT (l_suppkey, l_linenumber)) AS pairs, arg_max(l_orderkey, l_extendedprice) AS dearest, round(avg(l_quantity), 6) AS avg_quantity, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS corr, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(exp(sum(ln(1 + l_tax / 1000))), 4) AS growth FROM lineitem GROUP BY ALL")
def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional, distinct, ordered, statistical and product aggregates. Of equal prices the table's first row is the dearest, as in the SQL read by one thread."""
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    dearest = F.when(x.isNotNull() & F.col("l_orderkey").isNotNull(), F.struct(~F.isnan(x), -x, "place"))  # least: NaN, then falling prices, then the first row
    return placed(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.when(q > 25, 1)).alias("big"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_distinct(F.struct("l_suppkey", "l_linenumber")).alias("pairs"), F.min_by("l_orderkey", dearest).alias("dearest"), r6(F.avg(q), "avg_quantity"), r6(F.stddev_samp(q), "sd"), r6(F.corr(q, x), "corr"), F.round(F.percentile(x, F.lit(0.9)), 4).alias("p90"), F.round(F.exp(F.sum(F.log(1 + F.col("l_tax") / 1000))), 4).alias("growth"))


@register("distinct_list_having", "SELECT p_brand, list_sort(list(DISTINCT p_size)) AS sizes, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1")
def distinct_list_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values as a list; keys that stand more than once."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("sizes"), F.count("*").alias("n")).where("n > 1")


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@register("window_functions", f"SELECT event_id, CAST(row_number() {_W}) AS BIGINT) AS rn, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS session, round(lag(value, 2) {_W}), 6) AS lag2, round(lead(value) {_W}), 6) AS next, round(first_value(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id), 6) AS session_first, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS cume, count(*) OVER (PARTITION BY user_id) AS n, round(min(value) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS low_ahead, round(max(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS day_mark, round(quantile_cont(value, 0.5) {_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS prior_median, round(sum(value) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS sum3, CAST(ntile(5) OVER (ORDER BY value, event_id) AS BIGINT) AS quintile FROM events")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window functions; those of one specification share a sort."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = F.to_date("ts")
    e = table(spark, sf_dir, "events")
    e = C.sum_before(e, "value", F.lit(1), ["event_id"]).crossJoin(F.broadcast(e.agg(F.count("*").alias("all"))))
    return e.select(
        "event_id", F.row_number().over(w).cast("long").alias("rn"), F.dense_rank().over(Window.partitionBy("user_id").orderBy(d)).cast("long").alias("session"), r6(F.lag("value", 2).over(w), "lag2"), r6(F.lead("value").over(w), "next"), r6(F.first("value").over(Window.partitionBy("user_id", d).orderBy("ts", "event_id")), "session_first"), r6(F.cume_dist().over(Window.partitionBy("event_type").orderBy("value")), "cume"), F.count("*").over(Window.partitionBy("user_id")).alias("n"),
        r6(F.min("value").over(w.rowsBetween(0, Window.unboundedFollowing)), "low_ahead"), r6(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).over(Window.partitionBy(d)), "day_mark"), r6(F.percentile("value", F.lit(0.5)).over(w.rowsBetween(-5, -1)), "prior_median"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("sum3"), C.quantile_group(F.col("before"), F.col("all"), 5).alias("quintile"),
    )


@register("own_history_percentile", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT a.event_id, round(count(*) FILTER (WHERE b.value <= a.value) / count(*), 6) AS own_percentile FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 20 AND a.rn - 1 GROUP BY a.event_id HAVING count(*) = 20")
def own_history_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the prior twenty values at or below the present one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    e = table(spark, sf_dir, "events").withColumn("prior", F.collect_list("value").over(w)).where(F.size("prior") == 20)
    return e.select("event_id", r6(F.size(F.filter("prior", lambda x: x <= F.col("value"))) / 20, "own_percentile"))


@register("running_and_top_share", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), j AS (SELECT a.event_id, a.user_id, a.rn, b.value FROM e a JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 9 AND a.rn WHERE a.rn >= 10), k AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_id ORDER BY value DESC) AS o FROM j) SELECT event_id, round(sum(value) FILTER (WHERE o <= 3) / nullif(sum(value), 0), 6) AS top3_share FROM k GROUP BY event_id")
def running_and_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the three largest of the last ten values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    e = table(spark, sf_dir, "events").withColumn("x", F.collect_list("value").over(w)).where(F.size("x") == 10)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return e.select("event_id", r6(F.try_divide(add(F.slice(F.sort_array("x", asc=False), 1, 3)), add(F.col("x"))), "top3_share"))


@register("poisoned_running_max", "SELECT event_id, CASE WHEN count(*) FILTER (WHERE value < 3) OVER w = 0 THEN round(max(value) OVER w, 6) END AS running_high FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def poisoned_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running maximum that a gap makes unknown for the rest of the session."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    gaps = F.count(F.when(F.col("value") < 3, 1)).over(w)
    return table(spark, sf_dir, "events").select("event_id", F.when(gaps == 0, r6(F.max("value").over(w))).alias("running_high"))


@register("episodes", "WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM f) SELECT user_id, CAST(episode AS BIGINT) AS episode, min(event_id) AS first_id, count(*) AS observations, round(sum(value), 4) AS total FROM g GROUP BY ALL")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands."""
    from tidemark.operators.forensics import islands

    e = islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) <= F.expr("INTERVAL 8 HOURS"))
    return e.groupBy("user_id", "episode").agg(F.min("event_id").alias("first_id"), F.count("*").alias("observations"), F.round(F.sum("value"), 4).alias("total"))


@register("same_clock_history", "WITH h AS (SELECT user_id, extract(hour FROM ts) // 6 AS bucket, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT user_id, CAST(bucket AS INTEGER) AS bucket, day, round(lag(v) OVER w, 6) AS lag1, round(CASE WHEN count(v) OVER p >= 2 THEN avg(v) OVER p END, 6) AS mean5, round(CASE WHEN count(v) OVER p >= 3 THEN stddev_samp(v) OVER p END, 6) AS sd5 FROM h WINDOW w AS (PARTITION BY user_id, bucket ORDER BY day), p AS (PARTITION BY user_id, bucket ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def same_clock_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E22, I2, same_time concepts: the same clock bucket on prior days."""
    h = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.hour("ts") / 6).cast("int").alias("bucket"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("user_id", "bucket").orderBy("day")
    p = w.rowsBetween(-5, -1)
    return h.select("user_id", "bucket", "day", r6(F.lag("v").over(w), "lag1"), r6(F.when(F.count("v").over(p) >= 2, F.avg("v").over(p)), "mean5"), r6(F.when(F.count("v").over(p) >= 3, F.stddev_samp("v").over(p)), "sd5"))


@register("top_k_rows", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a top-k report with a full tie-break."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", r6("o_totalprice", "o_totalprice"))


@register("greedy_winners", "SELECT p_brand, p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) <= 2")
def greedy_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each family and role."""
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 2").select("p_brand", "p_type", "p_partkey")


@register("set_operations", "SELECT 'both' AS what, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.G: union, intersection, difference."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": c.intersect(s), "customers": c.subtract(s), "either": c.unionByName(s).distinct()}
    out = [d.select(F.lit(n).alias("what"), "k") for n, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("scalar_functions", "SELECT o_orderkey, lower(o_orderpriority) AS low, regexp_extract(o_orderpriority, '^(\\d)', 1) AS digit, strftime(o_orderdate, '%Y-%m') AS month, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, round(ln(o_totalprice), 6) AS lg, round(log10(o_totalprice), 6) AS lg10, round(sqrt(o_totalprice), 6) AS root, CAST(sign(o_totalprice - 100000) AS INTEGER) AS side, CAST(floor(o_totalprice) AS BIGINT) AS fl, substr(sha256(o_orderstatus || '|' || o_orderpriority), 1, 16) AS digest, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderkey & 7 AS low_bits, CAST(1 << (o_orderkey % 5) AS BIGINT) AS flag FROM orders")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.H: string, date, math, hash, bit and cast functions."""
    d, t, p = F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lower(p).alias("low"), F.regexp_extract(p, r"^(\d)", 1).alias("digit"), F.date_format(d, "yyyy-MM").alias("month"), F.last_day(d).alias("month_end"), F.weekday(d).alias("weekday"), r6(F.log(t), "lg"), r6(F.log10(t), "lg10"), r6(F.sqrt(t), "root"), F.signum(t - 100000).cast("int").alias("side"), F.floor(t).cast("long").alias("fl"), F.substring(F.sha2(F.concat(F.col("o_orderstatus"), F.lit("|"), p), 256), 1, 16).alias("digest"), F.substring(p, 1, 1).try_cast("int").alias("priority"), F.col("o_orderkey").bitwiseAND(7).alias("low_bits"), F.expr("shiftleft(1L, CAST(o_orderkey % 5 AS INT))").alias("flag"))


@register("json_and_arrays", "SELECT p_brand, CAST(list_sum(s) AS BIGINT) AS total, len(s) AS n, s[1] AS first, list_max(list_transform(s, lambda x: x * 2)) AS doubled FROM (SELECT p_brand, list(CAST(p_size AS BIGINT) ORDER BY p_partkey) AS s FROM part GROUP BY p_brand)")
def json_and_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.H arrays, 2.J: list functions over an ordered list."""
    s = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.col("p_size").cast("long").alias("v")))), lambda x: x["v"])
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(s.alias("s"))
    return g.select("p_brand", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("s").cast("long").alias("n"), F.element_at("s", 1).alias("first"), F.array_max(F.transform("s", lambda x: x * 2)).alias("doubled"))
