"""The one-minute pack over events: five securities (user_id modulo 5), days as sessions, hours as minutes of the grid."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import register
from tidemark.functions.sqltext import CHECK, SPARK, Sql
from tidemark.operators.clock import BLOCKS, FACTOR_TARGETS, Pack
from tidemark.plans import staged
from tidemark.sources.tables import table

#: Days of 24 hours in these tables: the lengths of 30 minutes, 20 sessions and 15 minutes are cut to what they hold.
SHORT = {"n30": 10, "n20": 8, "n15": 7}
#: Horizons of the queries with SQL; that of 30 minutes is in clock_factor_targets.
WITHIN = (1, 2, 3, 5, 10, 15)
COLUMNS = {block: [x.replace("breakout_dist_high_15m", "breakout_dist_high_7m").replace("breakout_dist_low_15m", "breakout_dist_low_7m") for x in names] for block, names in BLOCKS.items()}
COLUMNS["targets"] = [x for x in BLOCKS["targets"] if not x.endswith("_30m")]
KEYS = ["security_id", "session_no", "minute"]

GRID = """SELECT s.security_id, d.session_no, m.minute, e.open, e.high, e.low, e.close, e.volume, e.vwap, e.trade_count, avg(e.close) OVER (PARTITION BY d.session_no, m.minute) AS market,
  lag(e.last_close) OVER (PARTITION BY s.security_id, m.minute ORDER BY d.session_no) AS prior_session_close
FROM (SELECT DISTINCT user_id % 5 AS security_id FROM events) s, (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS session_no FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)) d, (SELECT CAST(unnest(range(24)) AS INTEGER) AS minute) m
LEFT JOIN (SELECT *, arg_max(close, minute) OVER (PARTITION BY security_id, day) AS last_close FROM (SELECT user_id % 5 AS security_id, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS minute, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume, avg(value) AS vwap, CAST(count(*) AS DOUBLE) AS trade_count FROM events GROUP BY ALL)) e
ON e.security_id = s.security_id AND e.day = d.day AND e.minute = m.minute"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed grid: a row for each security, session and minute, whether it traded or not."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("security_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("minute"), "ts", "value")
    b = e.groupBy("security_id", "day", "minute").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"), F.avg("value").alias("vwap"), F.count("*").cast("double").alias("trade_count"))
    b = b.withColumn("last_close", F.max_by("close", "minute").over(Window.partitionBy("security_id", "day")))
    days = e.select("day").distinct().withColumn("session_no", F.row_number().over(Window.orderBy("day")) - 1)
    spine = days.crossJoin(e.select("security_id").distinct()).withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(23))))
    g = spine.join(b, ["security_id", "day", "minute"], "left")
    return g.withColumn("market", F.avg("close").over(Window.partitionBy("session_no", "minute"))).withColumn("prior_session_close", F.lag("last_close").over(Window.partitionBy("security_id", "minute").orderBy("session_no"))).drop("day", "last_close")


def _stages(q: Sql) -> list[dict[str, str]]:
    return Pack(q, hist=8, beta_sessions=6, beta_least=40, **SHORT, horizons=WITHIN).stages()


def pack(spark: SparkSession, sf_dir: str, block: str) -> DataFrame:
    return staged.run(grid(spark, sf_dir), _stages, KEYS, COLUMNS[block], 6, SPARK)


for _block in BLOCKS:
    register(f"clock_{_block}", staged.sql(GRID, _stages, KEYS, COLUMNS[_block], 6, CHECK))(partial(pack, block=_block))


def _pair_stages(q: Sql) -> list[dict[str, str]]:
    from tidemark.operators.pairs import section

    p = Pack(q, hist=8, beta_sessions=6, beta_least=40, **SHORT, horizons=WITHIN)
    legs = ["resid_tod_tail_1m", *section("path")]
    bins = {f"b_{x}": f"CASE WHEN q_{x} IS NOT NULL THEN CAST(least(floor(q_{x} * 3e0), 2) AS INTEGER) END" for x in legs}
    return [*p.stages(), {f"past_{x}": p.past(x) for x in legs}, {f"q_{x}": f"({p.tail(x)} + 1e0) / 2e0" for x in legs}, bins]


def _pair_sql() -> str:
    from tidemark.operators.pairs import section

    wide = staged.as_sql(GRID, _pair_stages(CHECK), ["*"])
    parts = " UNION ALL ".join(f"SELECT '{b}' AS second, b_resid_tod_tail_1m * 3 + b_{b} AS cell, fwd_raw_1m AS y FROM wide" for b in section("path"))
    return f"WITH wide AS ({wide}), long AS ({parts}) SELECT second, CAST(cell AS INTEGER) AS cell, count(*) AS n, round(avg(y), 6) + 0e0 AS mean, round(stddev_samp(y), 6) AS sd FROM long WHERE cell IS NOT NULL AND y IS NOT NULL GROUP BY ALL"


@register("clock_pair_surfaces", _pair_sql())
def clock_pair_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L scan, B.2: the surfaces of a section's pairs on same-clock rank bins, all in one shuffle."""
    from tidemark.operators.pairs import section

    wide = staged.apply(grid(spark, sf_dir), _pair_stages(SPARK))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("second"), (F.col("b_resid_tod_tail_1m") * 3 + F.col(f"b_{b}")).cast("int").alias("cell")) for b in section("path"))))
    long = wide.select(rows.alias("x"), F.col("fwd_raw_1m").alias("y")).select("x.*", "y").where("cell IS NOT NULL AND y IS NOT NULL")
    return long.groupBy("second", "cell").agg(F.count("*").alias("n"), (F.round(F.avg("y"), 6) + F.lit(0.0)).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("sd"))


@register("clock_factor_targets")
def clock_factor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the targets of 30 minutes and those residualised with the session's frozen loadings, which complete clock_targets to 31."""
    from tidemark.operators.factors import factor_block

    g = staged.apply(grid(spark, sf_dir), Pack(SPARK, hist=8, beta_sessions=6, beta_least=40, **SHORT).target_stages())
    own = g.select(*KEYS, *(F.col(x) for x in BLOCKS["targets"] if x.endswith("_30m")))
    factor = factor_block(g, sessions=8, k=2, peers=3, least_sessions=8, least_rows=20, project=FACTOR_TARGETS).select(*KEYS, *FACTOR_TARGETS)
    return own.join(factor, KEYS, "left").selectExpr(*staged.outputs(KEYS, [*own.columns[3:], *FACTOR_TARGETS], SPARK))


def ranked(g: DataFrame, pack: Pack, **model: int) -> tuple[DataFrame, list[str]]:
    """Of each row of the grid, q_<leg>, its same-clock rank of every leg of the plans, and all targets; and the targets' names."""
    from tidemark.operators.factors import peer_block
    from tidemark.operators.pairs import EVENT_LEGS, legs

    wide = staged.apply(g, pack.stages())
    if pack.n15 != 15:  # the plans name the leg for its full length
        wide = wide.withColumnsRenamed({f"breakout_dist_{side}_{pack.n15}m": f"breakout_dist_{side}_15m" for side in ("high", "low")})
    raw = [x for x in BLOCKS["targets"] if x in wide.columns]
    project = {name: x for name, x in FACTOR_TARGETS.items() if x in raw}
    block = peer_block(wide.select(*KEYS, "r_1", "r_2", "liquidity_rank_20d", *raw), pack, project=project, **model)
    own = [x for x in legs() if x not in block.columns]
    both = wide.select(*KEYS, *own, *raw).join(block.select(*KEYS, *(x for x in legs() if x in block.columns), *project), KEYS, "left")
    w = pack.q.over(pack.h, 1, "security_id, minute", "session_no")
    seen = lambda x: f"CASE WHEN count(*) {w} = {pack.h} AND count({x}) {w} >= 1 THEN collect_list({x}) {w} END"
    past = {f"past_{x}": seen(x) if x in EVENT_LEGS else pack.past(x) for x in legs()}
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL AND past_{x} IS NOT NULL THEN (size(filter(past_{x}, p -> p < {x})) + 0.5e0 * size(filter(past_{x}, p -> p = {x}))) / size(past_{x}) END"
    targets = [*raw, *project]
    return staged.apply(both, [past, {f"q_{x}": rank(x) for x in legs()}]).select(*KEYS, *(f"q_{x}" for x in legs()), *targets), targets


@register("clock_plan_surfaces")
def clock_plan_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L scan, B.2, B.3: every listed pair at 3, 5 and 10 bins and every tail surface, over all 31 targets."""
    from tidemark.operators.pairs import scan

    q, targets = ranked(grid(spark, sf_dir), Pack(SPARK, hist=8, beta_sessions=6, beta_least=40, **SHORT), sessions=8, k=2, peers=3, least_sessions=8, least_rows=20)
    return scan(q, targets)
