"""Single scans, survivors, roles, cells, tails, conditions, groupings, replays of orders, calendars and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.operators import columns as C
from tidemark.operators import execution as X
from tidemark.operators import forensics as R
from tidemark.operators import panel as P
from tidemark.operators import selection as S
from tidemark.plans.panel_queries import _session_sql, r6s
from tidemark.plans.surface_queries import PANEL, _bin, panel, r6
from tidemark.sources.tables import BARS_SQL, bars, closes_and_means, table

_TAILS = (0.05, 0.1, 0.2)


def _scan_sql() -> str:
    q = ", ".join(f"quantile_cont(c, {t}) AS lo{k}, quantile_cont(c, {1 - t}) AS hi{k}" for k, t in enumerate(_TAILS))
    s = ", ".join(f"CASE WHEN names >= 20 AND lo{k} < hi{k} THEN CASE WHEN c <= lo{k} THEN -1 WHEN c >= hi{k} THEN 1 ELSE 0 END ELSE 0 END AS s{k}" for k in range(3))
    return f"""WITH {PANEL}, q AS (SELECT decision, count(c) AS names, {q} FROM p GROUP BY decision), x AS (SELECT decision, c, y, {s} FROM p JOIN q USING (decision) WHERE c IS NOT NULL AND y IS NOT NULL),
m AS (SELECT count(*) AS n, avg(s0 * y) AS e0, avg(s1 * y) AS e1, avg(s2 * y) AS e2, count(*) FILTER (WHERE s1 <> 0) AS active FROM x),
o AS (SELECT max(abs(t)) / nullif(sum(abs(t)), 0) AS share FROM (SELECT sum(s1 * y) AS t FROM x GROUP BY decision)),
k AS (SELECT corr(a, b) AS ic FROM (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2e0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS b FROM x)),
w AS (SELECT quantile_cont(c, 0.1) AS lo, quantile_cont(c, 0.9) AS hi FROM x), d AS (SELECT avg(y) FILTER (WHERE c >= hi) - avg(y) FILTER (WHERE c <= lo) AS spread FROM x, w),
r AS (SELECT *, CASE WHEN e1 <> 0 AND sign(e0) = sign(e1) THEN abs(e0) / abs(e1) END AS r0, CASE WHEN e1 <> 0 AND sign(e2) = sign(e1) THEN abs(e2) / abs(e1) END AS r2 FROM m)
SELECT n, round(ic, 6) AS rank_ic, round(spread, 5) + 0e0 AS top_bottom_spread, round(e1, 5) + 0e0 AS effect, active, round(share, 6) AS outlier_share, round(coalesce((coalesce(r0, r2) + coalesce(r2, r0)) / 2, 0), 5) AS retention, CAST(1 + coalesce(r0 >= 0.5, false)::INT + coalesce(r2 >= 0.5, false)::INT AS INTEGER) AS plateau FROM r, o, k, d"""


@register("single_scan", _scan_sql())
def single_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable by itself: rank correlation, spread of its tails, signals of each decision's tails with neighbouring fractions, and what they keep."""
    p = panel(spark, sf_dir)
    q = p.groupBy("decision").agg(F.count("c").alias("names"), *(F.percentile("c", F.lit(x)).alias(f"{side}{k}") for k, t in enumerate(_TAILS) for side, x in (("lo", t), ("hi", 1 - t))))
    signal = lambda k: F.when((F.col("names") >= 20) & (F.col(f"lo{k}") < F.col(f"hi{k}")), F.when(F.col("c") <= F.col(f"lo{k}"), -1).when(F.col("c") >= F.col(f"hi{k}"), 1).otherwise(0)).otherwise(0)
    x = p.join(q, "decision").where("c IS NOT NULL AND y IS NOT NULL").select("decision", "c", "y", *(signal(k).alias(f"s{k}") for k in range(3)))
    own = x.groupBy("decision").agg(F.count("*").alias("n"), *(F.sum(F.col(f"s{k}") * F.col("y")).alias(f"t{k}") for k in range(3)), F.count_if(F.col("s1") != 0).alias("active"))
    m = own.agg(F.sum("n").alias("n"), *(F.try_divide(F.sum(f"t{k}"), F.sum("n")).alias(f"e{k}") for k in range(3)), F.sum("active").alias("active"), F.try_divide(F.max(F.abs("t1")), F.sum(F.abs("t1"))).alias("share"))
    w = x.agg(F.percentile("c", F.lit(0.1)).alias("lo"), F.percentile("c", F.lit(0.9)).alias("hi"))
    d = x.crossJoin(F.broadcast(w)).agg((F.avg(F.when(F.col("c") >= F.col("hi"), F.col("y"))) - F.avg(F.when(F.col("c") <= F.col("lo"), F.col("y")))).alias("spread"))
    kept = lambda k: F.when((F.col("e1") != 0) & (F.signum(f"e{k}") == F.signum("e1")), F.abs(f"e{k}") / F.abs("e1"))
    out = m.crossJoin(d).crossJoin(R.spearman(x, "c", "y").select("rho")).withColumn("r0", kept(0)).withColumn("r2", kept(2))
    half = lambda k: F.coalesce((F.col(f"r{k}") >= 0.5).cast("int"), F.lit(0))
    retention = F.coalesce((F.coalesce("r0", "r2") + F.coalesce("r2", "r0")) / 2, F.lit(0.0))
    return out.select("n", r6("rho", "rank_ic"), (F.round("spread", 5) + 0.0).alias("top_bottom_spread"), (F.round("e1", 5) + 0.0).alias("effect"), "active", r6("share", "outlier_share"), F.round(retention, 5).alias("retention"), (1 + half(0) + half(2)).alias("plateau"))


@register("single_survivors", "WITH b AS (SELECT p_brand, min(p_size / 50e0) AS best_p, max(abs(p_retailprice - 1400)) AS best_statistic FROM part GROUP BY p_brand), r AS (SELECT *, row_number() OVER (ORDER BY best_p, best_statistic DESC, p_brand) AS k, count(*) FILTER (WHERE best_p <= 0.02) OVER () AS n FROM b) SELECT p_brand, round(best_p, 6) AS best_p, round(best_statistic, 6) AS best_statistic FROM r WHERE k <= 12 AND (n < 2 OR best_p <= 0.02)")
def single_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents that single tests leave over."""
    t = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") / 50).alias("p"), (F.col("p_retailprice") - 1400).alias("t"))
    return S.survivors(t, "p_brand", "p", "t", 0.02, 12).select("p_brand", r6("best_p", "best_p"), r6("best_statistic", "best_statistic"))


_ROLES = {"economic_footprint": "p_retailprice", "plateau": "p_size * 1e0", "negative_structure": "-p_retailprice", "informative_failure": "CASE WHEN p_size < 25 THEN p_retailprice / p_size END"}


def _roles_sql() -> str:
    won = " UNION ALL ".join(f"SELECT p_brand, p_partkey, {i} AS i, '{n}' AS role FROM part WHERE ({m}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY ({m}) DESC, p_type, p_partkey) = 1" for i, (n, m) in enumerate(_ROLES.items()))
    return f"WITH w AS ({won}), s AS (SELECT p_brand, p_partkey, min(i) AS first, string_agg(role, '|' ORDER BY i) AS roles FROM w GROUP BY ALL) SELECT p_brand, p_partkey, roles FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY first, p_partkey) <= 3"


@register("zoom_roles", _roles_sql())
def zoom_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners of each role in each family, a state with all its roles, a cap for each family."""
    p = table(spark, sf_dir, "part")
    return S.role_winners(p, "p_brand", "p_partkey", {n: F.expr(m) for n, m in _ROLES.items()}, ["p_type"], 3).select("p_brand", "p_partkey", "roles")


_TURNED = "list_transform(cells, lambda c: (c % 5) * 5 + c // 5)"


@register("canonical_cells", f"SELECT p_partkey, least(p_brand, p_type) AS a, greatest(p_brand, p_type) AS b, list_sort(list_distinct(CASE WHEN p_brand > p_type THEN {_TURNED} ELSE cells END)) AS cells FROM (SELECT p_partkey, p_brand, p_type, [CAST(p_size % 25 AS INTEGER), CAST(p_partkey % 25 AS INTEGER), CAST((p_size + p_partkey) % 25 AS INTEGER)] AS cells FROM part)")
def canonical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in the order of their ids; swapping them transposes the cells."""
    p = table(spark, sf_dir, "part")
    cells = F.array((F.col("p_size") % 25).cast("int"), (F.col("p_partkey") % 25).cast("int"), ((F.col("p_size") + F.col("p_partkey")) % 25).cast("int"))
    return p.select("p_partkey", S.oriented(F.col("p_brand"), F.col("p_type"), cells, 5).alias("x")).select("p_partkey", "x.*")


_STATES = [(0, 4), (0, 2), (4, 4), (2, 0)]


def _tail_sql() -> str:
    side = lambda r, k: f"{r} < 0.1e0" if k == 0 else f"{r} >= 0.9e0" if k == 4 else f"{_bin(r, 5)} = {k}"
    return f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{a}{b}' AS state, count(*) AS n, round(avg(y), 5) AS mean FROM p WHERE {side('ra', a)} AND {side('rb', b)}" for a, b in _STATES)


@register("tail_masks", _tail_sql())
def tail_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer tails of selected states; inner states stay whole. All states in one pass."""
    p = panel(spark, sf_dir).withColumn("ba", C.rank_bin(F.col("ra"), 5)).withColumn("bb", C.rank_bin(F.col("rb"), 5))
    masks = {f"{a}{b}": S.tail_mask([(F.col("ra"), F.col("ba"), a), (F.col("rb"), F.col("bb"), b)], 5, 0.1) for a, b in _STATES}
    one = p.agg(*(F.count_if(m).alias(f"n{k}") for k, m in masks.items()), *(F.avg(F.when(m, F.col("y"))).alias(f"m{k}") for k, m in masks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("state"), F.col(f"n{k}").alias("n"), F.round(f"m{k}", 5).alias("mean")) for k in masks))).alias("x")).select("x.*")


_MINUTE = "extract(hour FROM ts) * 60 + extract(minute FROM ts)"


@register("user_groupings", f"WITH e AS (SELECT event_type, CASE WHEN {_MINUTE} < 360 THEN 'night' WHEN {_MINUTE} < 720 THEN 'morning' WHEN {_MINUTE} < 1080 THEN 'afternoon' ELSE 'evening' END AS clock, CASE WHEN value >= 3 THEN CASE WHEN value < 20 THEN 'small' ELSE 'large' END ELSE 'missing' END AS size, value FROM events), g AS (SELECT 'clock' AS grouping, clock AS \"group\", value FROM e UNION ALL SELECT 'event_type_clock', event_type || '|' || clock, value FROM e UNION ALL SELECT 'size', size, value FROM e) SELECT grouping, \"group\", count(*) AS n, round(avg(value), 5) AS mean FROM g GROUP BY ALL")
def user_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by users' conditions: cut points, labels, and a policy for missing values."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    e = table(spark, sf_dir, "events").select("event_type", "value", S.condition(minute, [360, 720, 1080], ["night", "morning", "afternoon", "evening"]).alias("clock"), S.condition(F.when(F.col("value") >= 3, F.col("value")), [20.0], ["small", "large"], "category").alias("size"))
    out = S.groupings(e, [("clock",), ("event_type", "clock"), ("size",)], "value")
    return out.select("grouping", "group", "n", F.round("mean", 5).alias("mean"))


@register("split_factor_product", f"SELECT security_id, session_date, round(coalesce(exp(sum(ln(f)) OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1), 6) AS factor FROM (SELECT security_id, session_date, CASE WHEN (security_id + day(session_date)) % 11 = 0 THEN 2e0 WHEN (security_id + day(session_date)) % 13 = 0 THEN 0.5e0 ELSE 1e0 END AS f FROM ({BARS_SQL}))")
def split_factor_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of all later split factors of a security."""
    k = F.col("security_id") + F.day("session_date")
    f = F.when(k % 11 == 0, 2.0).when(k % 13 == 0, 0.5).otherwise(1.0)
    w = Window.partitionBy("security_id").orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)
    return bars(spark, sf_dir).select("security_id", "session_date", F.round(F.coalesce(F.exp(F.sum(F.log(f)).over(w)), F.lit(1.0)), 6).alias("factor"))


@register("market_orders", "WITH b AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events), o AS (SELECT event_id, user_id, ts, ts + INTERVAL 12 HOUR AS plan FROM events WHERE event_type = 'purchase'), i AS (SELECT o.*, coalesce(x.rn, 0) + 2 AS entry_rn FROM o ASOF LEFT JOIN b x ON o.user_id = x.user_id AND o.ts >= x.ts), j AS (SELECT i.*, coalesce(x.rn, 0) + 1 AS exit_rn FROM i ASOF LEFT JOIN b x ON i.user_id = x.user_id AND i.plan > x.ts) SELECT event_id AS order_id, e.ts AS entry_ts, x.ts AS exit_ts, round(x.value / nullif(e.value, 0) - 1, 6) + 0e0 AS gross_return FROM j JOIN b e ON e.user_id = j.user_id AND e.rn = entry_rn JOIN b x ON x.user_id = j.user_id AND x.rn = exit_rn")
def market_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders enter at the second bar after their decision and leave at the first bar from the planned exit on."""
    e = table(spark, sf_dir, "events")
    orders = e.where("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("decision_ts"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("planned_exit_ts"), F.lit(1).alias("direction"))
    out = X.market_orders(orders, e.select("user_id", F.col("ts").alias("bar_ts"), F.col("value").alias("open")), ["user_id"], entry_delay=2)
    return out.select("order_id", "entry_ts", "exit_ts", r6("gross_return", "gross_return"))


@register("quote_fills", "WITH o AS (SELECT event_id, user_id, ts, event_id % 2 = 0 AS buy, CAST(5 + event_id % 7 AS DOUBLE) AS quantity FROM events WHERE event_type = 'click'), j AS (SELECT o.*, q.ts AS quote_ts, q.value FROM o ASOF LEFT JOIN (SELECT * FROM events WHERE value > 4) q ON o.user_id = q.user_id AND o.ts <= q.ts), k AS (SELECT *, quote_ts <= ts + INTERVAL 6 HOUR AS hit FROM j) SELECT event_id, CASE WHEN hit THEN least(quantity, value * CASE WHEN buy THEN 2 ELSE 1 END * 0.25e0) ELSE 0e0 END AS filled, CASE WHEN hit THEN round(CASE WHEN buy THEN value ELSE value - 1 END, 6) END AS price, CASE WHEN NOT coalesce(hit, false) THEN 'missing_quote' WHEN quantity <= value * CASE WHEN buy THEN 2 ELSE 1 END * 0.25e0 THEN 'filled' ELSE 'partial' END AS status FROM k")
def quote_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketable orders of both sides at the first valid quote within a wait, a share of its size at most."""
    e = table(spark, sf_dir, "events")
    orders = e.where("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("order_ts"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (5 + F.col("event_id") % 7).cast("double").alias("quantity"))
    quotes = e.where("value > 4").select("user_id", F.col("ts").alias("quote_ts"), F.col("value").alias("ask"), (F.col("value") - 1).alias("bid"), (F.col("value") * 2).alias("ask_size"), F.col("value").alias("bid_size"))
    return X.quote_fills(orders, quotes, ["user_id"], 0.25, "6 hours").select("event_id", "filled", r6("price", "price"), "status")


@register("preclose_rows", "WITH l AS (SELECT user_id, event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS t FROM events), m AS (SELECT *, CAST(t AS DATE) AS day, extract(hour FROM t) * 60 + extract(minute FROM t) AS minute FROM l) SELECT user_id, day, arg_max(event_id, ts) AS event_id, count(*) FILTER (WHERE minute % 5 = 0) AS emits FROM m WHERE minute >= 570 AND minute <= 955 GROUP BY ALL")
def preclose_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row known at 15:55 of a session, and how many five-minute marks there were before."""
    local = F.from_utc_timestamp("ts", "America/New_York")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date(local).alias("day"), (F.hour(local) * 60 + F.minute(local)).alias("minute"))
    return e.where("minute >= 570 AND minute <= 955").groupBy("user_id", "day").agg(F.max_by("event_id", "ts").alias("event_id"), F.count_if(F.col("minute") % 5 == 0).alias("emits"))


@register("cell_union", f"WITH {PANEL}, x AS (SELECT {_bin('ra', 3)} * 3 + {_bin('rb', 3)} AS cell, y FROM p WHERE y IS NOT NULL) SELECT count(*) FILTER (WHERE cell IN (0, 4, 8)) AS n, round(sum(y) FILTER (WHERE cell IN (0, 4, 8)), 3) AS sum_y, round(avg(y) FILTER (WHERE cell IN (0, 4, 8)), 6) AS mean, round(count(*) FILTER (WHERE cell IN (0, 4, 8)) / count(*), 6) AS frequency FROM x WHERE cell IS NOT NULL")
def cell_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: an exact query of a union of cells."""
    p = panel(spark, sf_dir).withColumn("cell", C.rank_bin(F.col("ra"), 3) * 3 + C.rank_bin(F.col("rb"), 3))
    return S.cell_union(p, "cell", [0, 4, 8], 9, "y").select("n", F.round("sum_y", 3).alias("sum_y"), r6("mean", "mean"), r6("frequency", "frequency"))


@register("inspect_cell", f"WITH {PANEL}, x AS (SELECT security, month, y, CAST(year(decision) AS VARCHAR) AS fold FROM p WHERE {_bin('ra', 3)} * 3 + {_bin('rb', 3)} = 8 AND y IS NOT NULL), g AS (SELECT 'security' AS grouping, CAST(security AS VARCHAR) AS \"group\", y FROM x UNION ALL SELECT 'month', month, y FROM x UNION ALL SELECT 'fold', fold, y FROM x) SELECT grouping, \"group\", count(*) AS n, round(avg(y), 5) AS mean FROM g GROUP BY ALL")
def inspect_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: a state by security, month and fold."""
    p = panel(spark, sf_dir).where((C.rank_bin(F.col("ra"), 3) * 3 + C.rank_bin(F.col("rb"), 3) == 8) & F.col("y").isNotNull()).withColumn("fold", F.year("decision"))
    return S.groupings(p, [("security",), ("month",), ("fold",)], "y").select("grouping", "group", "n", F.round("mean", 5).alias("mean"))


@register("ols_attribution", "WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS y1, covar_pop(l_extendedprice, l_discount) AS y2, covar_pop(l_quantity, l_discount) AS x12, var_pop(l_quantity) AS x11, var_pop(l_discount) AS x22, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem), b AS (SELECT *, (y1 * x22 - y2 * x12) / (x11 * x22 - x12 * x12) AS b1, (y2 * x11 - y1 * x12) / (x11 * x22 - x12 * x12) AS b2 FROM m) SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 2) AS coefficient FROM b UNION ALL SELECT 'l_quantity', round(b1, 4) FROM b UNION ALL SELECT 'l_discount', round(b2, 2) FROM b")
def ols_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on several factors."""
    out = S.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return out.select("term", F.when(F.col("term") == "l_quantity", F.round("coefficient", 4)).otherwise(F.round("coefficient", 2)).alias("coefficient"))


@register("key_contract", "WITH r AS (SELECT event_id FROM events WHERE event_type <> 'click'), s AS (SELECT event_id, count(*) AS k FROM events WHERE value > 3 GROUP BY event_id), j AS (SELECT r.event_id AS a, s.event_id AS b, k FROM r FULL JOIN s ON r.event_id = s.event_id) SELECT count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, coalesce(max(k), 0) = 1 AS one_to_one FROM j")
def key_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots hold the same keys, once each: what either lacks, and whether the join is one to one."""
    e = table(spark, sf_dir, "events")
    left = e.where("event_type <> 'click'").groupBy(F.col("event_id").alias("key")).agg(F.count("*").alias("a"))
    right = e.where("value > 3").groupBy(F.col("event_id").alias("key")).agg(F.count("*").alias("b"))
    j = left.join(right, "key", "full")
    return j.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), (F.coalesce(F.greatest(F.max("a"), F.max("b")), F.lit(0)) == 1).alias("one_to_one"))


@register("flag_masks", "SELECT p_brand, bit_or(CAST(1 << (p_size % 16) AS BIGINT)) AS flags, bit_and(CAST(1 << (p_size % 16) AS BIGINT)) AS everywhere, bit_or(CAST(1 << (p_size % 16) AS BIGINT)) & ~8 AS without_third, bit_count(bit_or(CAST(1 << (p_size % 16) AS BIGINT))) AS set_flags, (bit_or(CAST(1 << (p_size % 16) AS BIGINT)) >> 5) & 1 = 1 AS has_fifth FROM part GROUP BY p_brand")
def flag_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.H bits: a set of flags as one number: collected, cleared, counted and asked."""
    flag = F.expr("shiftleft(1L, CAST(p_size % 16 AS INT))")
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.bit_or(flag).alias("flags"), F.bit_and(flag).alias("everywhere"))
    return g.select("p_brand", "flags", "everywhere", F.col("flags").bitwiseAND(F.bitwise_not(F.lit(8).cast("long"))).alias("without_third"), F.bit_count("flags").cast("tinyint").alias("set_flags"), (F.shiftright("flags", 5).bitwiseAND(1) == 1).alias("has_fifth"))


@register("cast_or_null", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, TRY_CAST(o_orderpriority AS INTEGER) AS whole, TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS day, TRY_CAST(o_orderstatus AS DOUBLE) AS number FROM orders")
def cast_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.H casts: what cannot be cast is NULL."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"), F.col("o_orderpriority").try_cast("int").alias("whole"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).try_cast("date").alias("day"), F.col("o_orderstatus").try_cast("double").alias("number"))


@register("pending_tasks", "SELECT c_custkey AS task FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run has left, against the journal of finished tasks."""
    journal = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    return S.pending(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task")), journal, ["task"])


@register("regime_context", f"WITH r AS (SELECT security_id, session_date, market_close, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY session_date), 0) - 1 AS r FROM ({BARS_SQL})), d AS (SELECT session_date, any_value(market_close) AS m, avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS breadth, stddev_samp(r) AS dispersion FROM r GROUP BY session_date), k AS (SELECT *, m / nullif(lag(m) OVER (ORDER BY session_date), 0) - 1 AS mr FROM d) SELECT session_date, round(breadth, 6) AS breadth, round(dispersion, 5) AS dispersion, round(CASE WHEN count(mr) OVER w >= 5 THEN stddev_samp(mr) OVER w END, 5) AS market_vol FROM k WINDOW w AS (ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def regime_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth, dispersion and the market's volatility of each session."""
    own = Window.partitionBy("security_id").orderBy("session_date")
    r = bars(spark, sf_dir).withColumn("r", F.try_divide("close", F.lag("close").over(own)) - 1)
    d = r.groupBy("session_date").agg(F.first("market_close").alias("m"), F.avg(F.when(F.col("r") > 0, 1.0).when(F.col("r").isNotNull(), 0.0)).alias("breadth"), F.stddev_samp("r").alias("dispersion"))
    by = Window.orderBy("session_date")  # one row a session
    w = by.rowsBetween(-19, 0)
    d = d.withColumn("mr", F.try_divide("m", F.lag("m").over(by)) - 1)
    return d.select("session_date", r6("breadth", "breadth"), F.round("dispersion", 5).alias("dispersion"), F.round(F.when(F.count("mr").over(w) >= 5, F.stddev_samp("mr").over(w)), 5).alias("market_vol"))


@register("business_days", "SELECT o_orderkey, CAST((SELECT count(*) FROM range(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER), INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6) AS BIGINT) AS days FROM orders")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.H dates: Mondays to Fridays between two dates, in closed form."""
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.weekdays(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).cast("long").alias("days"))


_MEANS = (2, 5, 10, 20)


@register("same_bucket_returns", "WITH h AS (SELECT user_id % 5 AS k, extract(hour FROM ts) // 4 AS bucket, CAST(ts AS DATE) AS day, arg_min(value, ts) AS o, arg_max(value, ts) AS c FROM events GROUP BY ALL), r AS (SELECT *, c / nullif(o, 0) - 1 AS r FROM h) SELECT k, CAST(bucket AS INTEGER) AS bucket, day, round(lag(r) OVER w, 6) + 0e0 AS same_bucket_return_lag1, " + ", ".join(f"round(CASE WHEN count(r) OVER p{n} >= {min(n, 5)} THEN avg(r) OVER p{n} END, 6) + 0e0 AS same_bucket_return_mean{n}" for n in _MEANS) + " FROM r WINDOW w AS (PARTITION BY k, bucket ORDER BY day), " + ", ".join(f"p{n} AS (PARTITION BY k, bucket ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in _MEANS))
def same_bucket_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K same_time: the return of the same clock bucket on prior sessions."""
    h = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("k"), F.floor(F.hour("ts") / 4).cast("int").alias("bucket"), F.to_date("ts").alias("day")).agg(F.min_by("value", "ts").alias("o"), F.max_by("value", "ts").alias("c"))
    w = Window.partitionBy("k", "bucket").orderBy("day")
    h = h.withColumn("r", F.try_divide("c", "o") - 1)
    means = [r6(F.when(F.count("r").over(w.rowsBetween(-n, -1)) >= min(n, 5), F.avg("r").over(w.rowsBetween(-n, -1))), f"same_bucket_return_mean{n}") for n in _MEANS]
    return h.select("k", "bucket", "day", r6(F.lag("r").over(w), "same_bucket_return_lag1"), *means)


@register("session_metrics_short", _session_sql((5, 10, 15, 30)))
def session_metrics_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, D4, K session: the session's statistics at 5, 10, 15 and 30 minutes from its ends."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "value", (1.0 + F.col("event_id") % 7).alias("v"))
    out = P.session_metrics(e, ["user_id", "day"], "ts", "value", "v", (5, 10, 15, 30))
    wide = [c for c in out.columns if c not in ("user_id", "day", "session_volume", "vwap_cross_count") and not c.startswith("opening_volume")]
    return out.select("user_id", "day", "session_volume", "vwap_cross_count", *r6s(*wide), *(F.round(c, 4).alias(c) for c in out.columns if c.startswith("opening_volume")))


@register("chronology", f"WITH b AS (SELECT session_date, close / nullif(open, 0) - 1 AS y, dense_rank() OVER (ORDER BY session_date) - 1 AS s FROM ({BARS_SQL})), w AS (SELECT 'rolling' AS kind, CAST(k * 5 AS VARCHAR) AS label, y FROM b, range(0, 200) t(k) WHERE s >= k * 5 AND s < k * 5 + 10 AND (SELECT max(s) FROM b) >= k * 5 + 9) SELECT kind, label, count(y) AS n, round(avg(y), 6) + 0e0 AS mean FROM (SELECT 'month' AS kind, strftime(session_date, '%Y-%m') AS label, y FROM b UNION ALL SELECT * FROM w) GROUP BY ALL")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect by month, and over rolling spans of ten sessions every five (sixty and twenty in long tables). Sessions are summed before the spans are."""
    b = bars(spark, sf_dir).groupBy("session_date").agg(F.count(F.try_divide("close", "open")).alias("n"), F.sum(F.try_divide("close", "open") - 1).alias("t"))
    last = Window.orderBy("session_date")  # one row a session
    d = b.withColumn("s", (F.row_number().over(last) - 1)).withColumn("last", F.count("*").over(Window.partitionBy()) - 1)
    starts = F.filter(F.transform(F.sequence(F.floor(F.col("s") / 5) - 1, F.floor(F.col("s") / 5)), lambda k: k * 5), lambda k: (k >= 0) & (k + 9 <= F.col("last")))
    rolling = d.select(F.lit("rolling").alias("kind"), F.explode(F.transform(starts, lambda k: k.cast("string"))).alias("label"), "n", "t")
    both = d.select(F.lit("month").alias("kind"), F.date_format("session_date", "yyyy-MM").alias("label"), "n", "t").unionByName(rolling)
    return both.groupBy("kind", "label").agg(F.sum("n").alias("n"), r6(F.try_divide(F.sum("t"), F.sum("n")), "mean"))


@register("candidate_replay")
def candidate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate's signals with delayed entries, hedge legs and a reason for each that is not traded; checked against a replay in the tests."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("security_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")
    late = e.withColumn("exit_ts", F.lead("ts", 4).over(w)).withColumn("exit_price", F.lead("value", 4).over(w))
    basis = F.element_at(F.array(*map(F.lit, ("raw", "benchmark_adjusted", "beta_residual", "other"))), (F.col("event_id") % 17 % 4 + 1).cast("int"))
    s = late.select(F.col("event_id").alias("signal_id"), "security_id", F.col("ts").alias("decision_ts"), F.col("ts").alias("entry_ts"), F.col("value").alias("entry_price"), "exit_ts", "exit_price", F.when(F.col("event_id") % 5 == 0, -1).otherwise(1).alias("direction"), basis.alias("basis"), F.when(F.col("event_id") % 7 != 0, 0.8).alias("beta"), F.col("ts").alias("benchmark_entry_ts"), F.col("exit_ts").alias("benchmark_exit_ts"), (F.col("exit_price") + 10).alias("benchmark_exit_price"))
    b = e.select("security_id", "ts", F.col("value").alias("price"))
    return X.candidate_replay(s, b, e.groupBy("ts").agg((F.avg("value") + 10).alias("price")), 30, 1.0, 1.0).select("signal_id", "status", r6("gross", "gross"), r6("net", "net"))


@register("independent_signals")
def independent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and conflicting signals of several strategies; checked against a replay in the tests."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    s = e.select(F.col("event_id").alias("signal_id"), "event_type", F.col("user_id").cast("string").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("signal_ts"), F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("side"))
    s = s.withColumnRenamed("event_type", "strategy").withColumn("planned_exit_ts", F.col("signal_ts") + F.expr("INTERVAL 30 HOURS"))
    return X.independent_signals(s)


def _crossfit_sql() -> str:
    lift = lambda n, s: f"{s} / nullif({n}, 0) - sum({s}) OVER fa / nullif(sum({n}) OVER fa, 0) - sum({s}) OVER fb / nullif(sum({n}) OVER fb, 0) + sum({s}) OVER f / nullif(sum({n}) OVER f, 0)"
    return f"""WITH {PANEL}, x AS (SELECT {_bin('ra', 3)} AS a, {_bin('rb', 3)} AS b, CAST(year(decision) % 3 AS INTEGER) AS fold, y FROM p WHERE ra IS NOT NULL AND rb IS NOT NULL AND y IS NOT NULL),
h AS (SELECT fold, a, b, count(*) AS n, sum(y) AS s FROM x GROUP BY ALL), g AS (SELECT f.fold, c.a, d.b, coalesce(n, 0) AS hn, coalesce(s, 0e0) AS hs FROM (SELECT DISTINCT fold FROM x) f, (SELECT unnest([0, 1, 2]) AS a) c, (SELECT unnest([0, 1, 2]) AS b) d LEFT JOIN h ON h.fold = f.fold AND h.a = c.a AND h.b = d.b),
t AS (SELECT *, sum(hn) OVER (PARTITION BY a, b) - hn AS tn, sum(hs) OVER (PARTITION BY a, b) - hs AS ts FROM g),
l AS (SELECT fold, a * 3 + b AS cell, hn, tn, hs / nullif(hn, 0) AS hm, ts / nullif(tn, 0) AS tm, {lift('tn', 'ts')} AS tl, {lift('hn', 'hs')} AS hl FROM t WINDOW f AS (PARTITION BY fold), fa AS (PARTITION BY fold, a), fb AS (PARTITION BY fold, b)),
k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY round(tm, 9)) + (count(*) OVER (PARTITION BY fold, round(tm, 9)) - 1) / 2e0 AS rt, rank() OVER (PARTITION BY fold ORDER BY round(hm, 9)) + (count(*) OVER (PARTITION BY fold, round(hm, 9)) - 1) / 2e0 AS rh FROM l WHERE hn > 0 AND tn > 0),
m AS (SELECT fold, corr(rt, rh) AS rho, (sum(hn * tm * hm) - sum(hn * tm) * sum(hn * hm) / sum(hn)) / nullif(sum(hn * tm * tm) - sum(hn * tm) * sum(hn * tm) / sum(hn), 0) AS slope, max(hm) - min(hm) AS spread FROM k GROUP BY fold),
c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(abs(tl), 9) DESC NULLS LAST, cell) = 1)
SELECT fold, cell, CAST(hn AS BIGINT) AS heldout_n, round(tm, 5) AS train_mean, round(tl, 5) + 0e0 AS train_lift, round(hm, 5) AS heldout_mean, round(hl, 5) + 0e0 AS heldout_lift, round(spread, 5) AS heldout_spread, round(rho, 5) + 0e0 AS spearman, round(slope, 3) + 0e0 AS slope FROM c JOIN m USING (fold)"""


@register("crossfit_surface", _crossfit_sql())
def crossfit_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell that the other folds choose, judged on the one held out, and how the surfaces agree. One shuffle to cells; the rest is a small table."""
    p = panel(spark, sf_dir).select(C.rank_bin(F.col("ra"), 3).alias("a"), C.rank_bin(F.col("rb"), 3).alias("b"), (F.year("decision") % 3).alias("fold"), "y").where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
    return R.crossfit(p, "fold", "a", "b", "y", 3).select("fold", "cell", "heldout_n", *((F.round(c, 3 if c == "slope" else 5) + 0.0).alias(c) for c in ("train_mean", "train_lift", "heldout_mean", "heldout_lift", "heldout_spread", "spearman", "slope")))


def _dossier_sql() -> str:
    ok = "ra IS NOT NULL AND rb IS NOT NULL AND y IS NOT NULL"
    inside = f"{_bin('ra', 5)} = 4 AND {_bin('rb', 5)} = 3"
    parts = [f"SELECT 'distance' AS section, CAST(abs({_bin('ra', 5)} - 4) + abs({_bin('rb', 5)} - 3) AS VARCHAR) AS label, y FROM p WHERE {ok}", f"SELECT 'summary', 'all', y FROM p WHERE {ok} AND {inside}", f"SELECT 'month', month, y FROM p WHERE {ok} AND {inside}", f"SELECT 'fold', CAST(year(decision) AS VARCHAR), y FROM p WHERE {ok} AND {inside}"]
    parts += [f"SELECT 'tail', '{f}', y FROM p WHERE {ok} AND ra >= 1 - {f}e0" for f in (0.2, 0.1, 0.05, 0.02, 0.01)]
    parts += [f"SELECT 'resolution', '{k}', y FROM p WHERE {ok} AND {_bin('ra', k)} = {int(0.9 * k)} AND {_bin('rb', k)} = {int(0.7 * k)}" for k in (3, 5, 10)]
    return f"WITH {PANEL}, x AS ({' UNION ALL '.join(parts)}) SELECT section, label, count(*) AS n, round(avg(y), 5) AS mean, round(stddev_samp(y), 4) AS sd FROM x GROUP BY ALL"


@register("dossier", _dossier_sql())
def dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state by itself, by month and year, by distance from it, along its tail, and at other resolutions, in one pass."""
    from tidemark.operators.dossier import dossier as make

    out = make(panel(spark, sf_dir), "ra", "rb", (4, 3), 5, "y", {"month": F.col("month"), "fold": F.year("decision")})
    return out.select("section", "label", "n", F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"))


_AUTOPSY = """WITH x AS (SELECT user_id AS s, strftime(ts, '%Y-%m-%d') AS m, day(ts) <= 15 AS h, value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 1 AS y FROM events), k AS (SELECT * FROM x WHERE y IS NOT NULL), q AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM k),
w AS (SELECT count(*) AS n, sum(y) AS total, avg(greatest(least(y, hi), lo)) AS wins, avg(y) FILTER (WHERE h) AS h1, avg(y) FILTER (WHERE NOT h) AS h2, sum(CASE WHEN y >= hi THEN y ELSE 0 END) AS top FROM k, q),
gs AS (SELECT s, sum(y) AS t, count(*) AS c FROM k GROUP BY s), gm AS (SELECT m, sum(y) AS t, count(*) AS c FROM k GROUP BY m),
bs AS (SELECT gs.t, gs.c FROM gs, w ORDER BY round(gs.t * sign(w.total), 9) DESC, CAST(s AS VARCHAR) DESC LIMIT 1), bm AS (SELECT gm.t, gm.c FROM gm, w ORDER BY round(gm.t * sign(w.total), 9) DESC, m DESC LIMIT 1),
c AS (SELECT w.*, w.total / n AS mean, (w.total - bs.t) / (n - bs.c) AS ws, (w.total - bm.t) / (n - bm.c) AS wm, (SELECT count(*) FILTER (WHERE sign(gm.t) = sign(w2.total)) FROM gm, w w2) AS same, (SELECT count(*) FROM gm) AS groups FROM w, bs, bm),
r AS (SELECT 'rows' AS "check", CAST(n AS DOUBLE) AS value, n >= 100 AS passed FROM c UNION ALL SELECT 'mean', mean, mean <> 0 FROM c UNION ALL SELECT 'without_best_security', ws, sign(ws) = sign(total) FROM c UNION ALL SELECT 'without_best_month', wm, sign(wm) = sign(total) FROM c UNION ALL SELECT 'winsorised', wins, sign(wins) = sign(total) FROM c
  UNION ALL SELECT 'halves', least(h1, h2), sign(h1) = sign(total) AND sign(h2) = sign(total) FROM c UNION ALL SELECT 'months', same / groups, same * 2 > groups FROM c UNION ALL SELECT 'after_costs', mean - sign(total) * 0.0005e0, sign(mean - sign(total) * 0.0005e0) = sign(total) FROM c UNION ALL SELECT 'top_share', top / total, abs(top / total) < 0.5 FROM c)
SELECT "check", round(value, 5) + 0e0 AS value, passed FROM r"""


@register("autopsy", _AUTOPSY)
def autopsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that a candidate has to stand, each with its value."""
    from tidemark.operators.dossier import autopsy as run

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("y", F.try_divide("value", F.lag("value").over(w)) - 1).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return run(e, "y", "user_id", "day", F.day("ts") <= 15, 0.0005).select("check", (F.round("value", 5) + 0.0).alias("value"), "passed")


@register("state_lifecycle", f"WITH x AS (SELECT security_id, session_date, CAST(close > vwap AS INTEGER) AS o FROM ({BARS_SQL})), y AS (SELECT o, coalesce(lag(o) OVER w, 0) AS p, lead(o) OVER w AS n FROM x WINDOW w AS (PARTITION BY security_id ORDER BY session_date)) SELECT count(*) FILTER (WHERE o = 1 AND p = 0) AS entries, count(*) FILTER (WHERE o = 1 AND n = 0) AS exits, CAST(sum(o) AS BIGINT) AS rows_in, round(sum(o) / nullif(count(*) FILTER (WHERE o = 1 AND p = 0), 0), 6) AS mean_run FROM y")
def state_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a state begins, lasts and ends."""
    from tidemark.operators.dossier import lifecycle

    return lifecycle(closes_and_means(spark, sf_dir), ["security_id"], ["session_date"], F.col("close") > F.col("vwap")).select("entries", "exits", "rows_in", r6("mean_run", "mean_run"))


def _stability_sql() -> str:
    names = ["a", "b", "c", "ra"]
    long = " UNION ALL ".join(f"SELECT decision, year(decision) % 3 AS fold, y, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM p WHERE {c} IS NOT NULL" for c in names)
    q = ", ".join(f"quantile_cont(x, {t}) AS lo{k}, quantile_cont(x, {1 - t}) AS hi{k}" for k, t in enumerate(_TAILS))
    s = ", ".join(f"CASE WHEN names >= 20 AND lo{k} < hi{k} THEN CASE WHEN x <= lo{k} THEN -1 WHEN x >= hi{k} THEN 1 ELSE 0 END ELSE 0 END AS s{k}" for k in range(3))
    return f"""WITH {PANEL}, l AS ({long}), u AS (SELECT feature, decision, count(*) AS names, {q} FROM l GROUP BY ALL), x AS (SELECT l.feature, l.decision, fold, y, {s} FROM l JOIN u ON u.feature = l.feature AND u.decision = l.decision WHERE y IS NOT NULL),
d AS (SELECT feature, decision, count(*) AS n, sum(s0 * y) AS t0, sum(s1 * y) AS t1, sum(s2 * y) AS t2, count(*) FILTER (WHERE s1 <> 0) AS active FROM x GROUP BY ALL),
f AS (SELECT feature, count(e) AS folds, quantile_cont(e, 0.5) AS middle, abs(avg(sign(e))) AS consistency FROM (SELECT feature, fold, sum(s1 * y) / count(*) AS e FROM x GROUP BY ALL) GROUP BY feature),
a AS (SELECT feature, sum(n) AS n, sum(t0) / sum(n) AS e0, sum(t1) / sum(n) AS e1, sum(t2) / sum(n) AS e2, sum(active) AS active, max(abs(t1)) / nullif(sum(abs(t1)), 0) AS outlier_share, CAST(count(*) AS DOUBLE) AS g, sum(t1 * t1) AS tt, sum(t1 * n) AS tn, CAST(sum(n * n) AS DOUBLE) AS nn FROM d GROUP BY feature),
z AS (SELECT *, sqrt(greatest(tt - 2 * e1 * tn + e1 * e1 * nn, 0) * g / (g - 1)) / n AS se, CASE WHEN e1 <> 0 AND sign(e0) = sign(e1) THEN abs(e0) / abs(e1) END AS r0, CASE WHEN e1 <> 0 AND sign(e2) = sign(e1) THEN abs(e2) / abs(e1) END AS r2 FROM a JOIN f USING (feature)),
s AS (SELECT *, coalesce({C.normal_two_sided_sql('(e1 / nullif(se, 0))')}, 1) AS p, least(1, abs(middle) / nullif(abs(e1), 0)) AS magnitude, coalesce((coalesce(r0, r2) + coalesce(r2, r0)) / 2, 0) AS retention, 1 + coalesce(r0 >= 0.5, false)::INT + coalesce(r2 >= 0.5, false)::INT AS plateau FROM z),
h AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature) AS raw, row_number() OVER (ORDER BY p, feature) AS k FROM s),
v AS (SELECT *, least(1, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM h),
w AS (SELECT *, coalesce(q <= 1 AND folds >= 2 AND consistency >= 0.3 AND magnitude >= 0.05 AND active >= 20 AND outlier_share <= 0.25 AND retention >= 0.05 AND plateau >= 1, false) AS passes, cume_dist() OVER (ORDER BY round(abs(e1), 12)) AS place FROM v)
SELECT feature, CAST(n AS BIGINT) AS n, round(e1, 5) + 0e0 AS effect, round(q, 5) AS q_value, folds, round(consistency, 6) AS consistency, round(magnitude, 5) AS magnitude, round(retention, 5) AS retention, CAST(plateau AS INTEGER) AS plateau, CAST(active AS BIGINT) AS active, round(outlier_share, 6) AS outlier_share, passes, round(CASE WHEN passes THEN place * -log10(greatest(q, 1e-300)) * consistency * magnitude * greatest(retention, 0.01) * ln(1 + n) END, 4) + 0e0 AS score FROM w"""


@register("stability_gates", _stability_sql())
def stability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single scans of several features with folds, false-discovery control over all of them, gates and a score."""
    from tidemark.operators import stability as T

    p = panel(spark, sf_dir).withColumn("fold", F.year("decision") % 3)
    out = T.gated(T.scans(p, ["a", "b", "c", "ra"], "y", "decision", "fold"), T.Gates(q=1.0, consistency=0.3, retention=0.05, plateau=1))
    return out.select("feature", "n", (F.round("effect", 5) + 0.0).alias("effect"), F.round("q_value", 5).alias("q_value"), "folds", r6("consistency", "consistency"), F.round("magnitude", 5).alias("magnitude"), F.round("retention", 5).alias("retention"), "plateau", "active", r6("outlier_share", "outlier_share"), "passes", (F.round("score", 4) + 0.0).alias("score"))


#: Windows and least observations of the betas: short, middle and long histories of these tables.
_BETAS = ((6, 5), (12, 6), (20, 10))


def _beta_sql() -> str:
    one = lambda n, least: f"round(CASE WHEN count(CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN 1 END) OVER p{n} >= {least} THEN covar_samp(r, m) OVER p{n} / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER p{n}, 0) END, 5) + 0e0 AS beta_{n}"
    return f"WITH b AS (SELECT security_id, session_date, close / nullif(lag(close) OVER w, 0) - 1 AS r, market_close / nullif(lag(market_close) OVER w, 0) - 1 AS m FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY security_id ORDER BY session_date)) SELECT security_id, session_date, {', '.join(one(*x) for x in _BETAS)} FROM b WINDOW {', '.join(f'p{n} AS (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)' for n, _ in _BETAS)}"


@register("beta_windows", _beta_sql())
def beta_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: prior betas over several windows, which share one sort."""
    w = Window.partitionBy("security_id").orderBy("session_date")
    b = bars(spark, sf_dir).withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1).withColumn("m", F.try_divide("market_close", F.lag("market_close").over(w)) - 1)
    return b.select("security_id", "session_date", *((F.round(P.beta(b, "security_id", "session_date", "r", "m", n, least), 5) + 0.0).alias(f"beta_{n}") for n, least in _BETAS))


@register("session_targets", "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, value, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS s FROM events), o AS (SELECT user_id, s, min(ts) AS first FROM e GROUP BY ALL), n AS (SELECT e.user_id, e.s, arg_min(value, ts) AS entry FROM e JOIN o USING (user_id, s) WHERE ts >= first + INTERVAL 60 MINUTE GROUP BY ALL), c AS (SELECT user_id, s, any_value(day) AS day, arg_max(value, ts) AS last FROM e GROUP BY ALL) SELECT c.user_id, c.day, round(x1.last / nullif(n.entry, 0) - 1, 6) + 0e0 AS target_1, round(x3.last / nullif(n.entry, 0) - 1, 6) + 0e0 AS target_3 FROM c LEFT JOIN n ON n.user_id = c.user_id AND n.s = c.s + 1 LEFT JOIN c x1 ON x1.user_id = c.user_id AND x1.s = c.s + 1 LEFT JOIN c x3 ON x3.user_id = c.user_id AND x3.s = c.s + 3")
def session_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: entry at the next session's first price after a delay from its open, exit at the close of the h-th session, by session numbers."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), "value")
    open_ = F.min("ts").over(Window.partitionBy("user_id", "day"))
    e = e.withColumn("late", F.col("ts") >= open_ + F.expr("INTERVAL 60 MINUTES"))
    c = e.groupBy("user_id", "day").agg(F.max_by("value", "ts").alias("last"), F.min_by("value", F.when(F.col("late"), F.col("ts"))).alias("entry"))
    w = Window.partitionBy("user_id").orderBy("day")
    target = lambda h: r6(F.try_divide(F.lead("last", h).over(w), F.lead("entry", 1).over(w)) - 1, f"target_{h}")
    return c.select("user_id", "day", target(1), target(3))


@register("reselected_cell", f"WITH {PANEL}, c AS (SELECT {_bin('ra', 3)} * 3 + {_bin('rb', 3)} AS cell, CAST(year(decision) % 2 AS INTEGER) AS half, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM p WHERE ra IS NOT NULL AND rb IS NOT NULL AND y IS NOT NULL GROUP BY ALL), t AS (SELECT cell, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM c GROUP BY cell), a AS (SELECT cell FROM t ORDER BY round(s / n, 9) DESC, cell LIMIT 1), b AS (SELECT half, cell, n, s, q, sum(n) OVER (PARTITION BY half) AS total FROM c QUALIFY row_number() OVER (PARTITION BY half ORDER BY round(s / n, 9) DESC, cell) = 1) SELECT half, b.cell, n, round(s / n, 5) AS mean, round(sqrt((q - s * s / n) / (n - 1)) / sqrt(n), 5) AS se, round(n / total, 6) AS frequency, CASE WHEN b.cell = a.cell THEN round((s / n) / (sqrt((q - s * s / n) / (n - 1)) / sqrt(n)), 3) END AS t FROM b, a")
def reselected_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell chosen anew from counts, sums and squares; its inference is missing where the cell is not the one that was tested."""
    p = panel(spark, sf_dir).select((C.rank_bin(F.col("ra"), 3) * 3 + C.rank_bin(F.col("rb"), 3)).alias("cell"), (F.year("decision") % 2).alias("half"), "y").where("cell IS NOT NULL AND y IS NOT NULL")
    c = p.groupBy("cell", "half").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    tested = c.groupBy("cell").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.max_by("cell", F.struct(F.round(F.col("s") / F.col("n"), 9), -F.col("cell"))).alias("tested"))
    w = Window.partitionBy("half")
    b = c.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.round(F.col("s") / F.col("n"), 9).desc(), "cell"))).where("r = 1").crossJoin(F.broadcast(tested))
    mean, se = F.col("s") / F.col("n"), F.sqrt(F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)) / F.sqrt(F.col("n").cast("double"))
    return b.select("half", "cell", "n", F.round(mean, 5).alias("mean"), F.round(se, 5).alias("se"), r6(F.col("n") / F.col("total"), "frequency"), F.when(F.col("cell") == F.col("tested"), F.round(F.try_divide(mean, se), 3)).alias("t"))
