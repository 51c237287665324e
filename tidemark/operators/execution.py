"""Costs, fills and replays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leg_return(entry: Column, exit_: Column, direction: Column) -> Column:
    return direction * (exit_ / F.nullif(entry, F.lit(0.0)) - 1)


def friction(entry_bps: float, exit_bps: float, borrow_bps_day: float, days: Column, direction: Column) -> Column:
    """Entry, exit and, for shorts, borrow costs as a return."""
    return (F.lit(entry_bps + exit_bps) + F.when(direction < 0, borrow_bps_day * days).otherwise(0.0)) / 1e4


def break_even(gross: Column, turnover: Column) -> Column:
    return gross / F.nullif(turnover, F.lit(0.0)) * 1e4


def drawdown(df: DataFrame, order: list[str], ret: str, by: list[str]) -> DataFrame:
    """Running additive equity and its distance from the running peak (from zero)."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("equity", F.sum(ret).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("drawdown", F.col("equity") - F.greatest(F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


def one_position(signals: DataFrame, key: str) -> DataFrame:
    """Signals (key, signal_id, entry_ts, exit_ts, entry_price, exit_price) replayed with one open position a security; each gets a status. Order-dependent: one grouped pass a security."""
    schema = f"{key} long, signal_id long, entry_ts timestamp, exit_ts timestamp, entry_price double, exit_price double, status string"

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entry_ts", "signal_id"])
        free, out = None, []
        for entry, exit_, a, b in zip(pdf["entry_ts"], pdf["exit_ts"], pdf["entry_price"], pdf["exit_price"]):
            if pd.isna(exit_) or pd.isna(b):
                out.append("no_exit")
            elif not a > 0:
                out.append("bad_entry_price")
            elif exit_ <= entry:
                out.append("exit_not_after_entry")
            elif free is not None and entry < free:
                out.append("position_open")
            else:
                out.append("filled")
                free = exit_
        return pdf.assign(status=out)

    return signals.groupBy(key).applyInPandas(f, schema)


def marketable_fill(orders: DataFrame, quotes: DataFrame, keys: list[str], participation: float) -> DataFrame:
    """Fill at the first valid quote: its price, and at most a share of its size."""
    from tidemark.operators.joins import asof

    valid = quotes.where((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("ask_size") > 0))
    out = asof(orders, valid, keys, "order_ts", "quote_ts", ["ask", "ask_size"], forward=True)
    return out.withColumn("filled", F.least(F.col("quantity"), F.floor(F.col("ask_size") * participation))).withColumn("price", F.when(F.col("filled") > 0, F.col("ask")))


def quote_fills(orders: DataFrame, quotes: DataFrame, keys: list[str], participation: float, wait: str) -> DataFrame:
    """Orders (side buy or sell, quantity, order_ts) filled at the first valid quote within a wait: its price on their side, a share of its size at most."""
    from tidemark.operators.joins import asof

    if not 0 < participation <= 1:
        raise ValueError("participation is a share")
    valid = quotes.where((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (F.col("bid_size") > 0) & (F.col("ask_size") > 0))
    out = asof(orders, valid.withColumn("hit_ts", F.col("quote_ts")), keys, "order_ts", "quote_ts", ["hit_ts", "bid", "ask", "bid_size", "ask_size"], forward=True)
    hit, buy = F.coalesce(F.col("hit_ts") <= F.col("order_ts") + F.expr(f"INTERVAL {wait}"), F.lit(False)), F.col("side") == "buy"
    room = F.when(buy, F.col("ask_size")).otherwise(F.col("bid_size")) * participation
    out = out.withColumn("filled", F.when(hit, F.least(F.col("quantity"), room)).otherwise(0.0)).withColumn("price", F.when(hit, F.when(buy, F.col("ask")).otherwise(F.col("bid"))))
    return out.withColumn("status", F.when(~hit, "missing_quote").when(F.col("filled") == F.col("quantity"), "filled").otherwise("partial")).drop("hit_ts", "bid", "ask", "bid_size", "ask_size")


def market_orders(orders: DataFrame, bars: DataFrame, keys: list[str], entry_delay: int = 1, exit_delay: int = 0) -> DataFrame:
    """Orders (order_id, decision_ts, planned_exit_ts, direction) on bars (bar_ts, open): entry at the entry_delay-th bar after the decision, exit exit_delay bars after the first one at or after the planned exit. Orders without both have no row."""
    from tidemark.operators.joins import asof

    numbered = bars.select(*keys, "bar_ts", "open", F.row_number().over(Window.partitionBy(*keys).orderBy("bar_ts")).alias("bar"))
    at = asof(orders, numbered, keys, "decision_ts", "bar_ts", ["bar"]).withColumnRenamed("bar", "_at")
    at = asof(at, numbered, keys, "planned_exit_ts", "bar_ts", ["bar"], strict=True).withColumnRenamed("bar", "_upto")
    first = F.coalesce("_at", F.lit(0))
    at = at.withColumn("_entry", first + entry_delay).withColumn("_exit", F.greatest(F.coalesce("_upto", F.lit(0)), first) + 1 + exit_delay)
    one = lambda side: numbered.select(*keys, F.col("bar").alias(f"_{side}"), F.col("bar_ts").alias(f"{side}_ts"), F.col("open").alias(f"{side}_price"))
    out = at.join(one("entry"), [*keys, "_entry"]).join(one("exit"), [*keys, "_exit"])
    return out.withColumn("gross_return", leg_return(F.col("entry_price"), F.col("exit_price"), F.col("direction"))).drop("_at", "_upto", "_entry", "_exit")


def passive_fill(orders: DataFrame, trades: DataFrame, keys: list[str], width: float) -> DataFrame:
    """A resting buy fills at its limit when a later trade goes strictly through it before it expires."""
    from tidemark.operators.joins import bucketed_range

    lo, hi = (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 for c in ("order_ts", "expires"))
    at = F.unix_micros(F.col("trade_ts").cast("timestamp")) / 1e6
    hits = bucketed_range(orders, trades, keys, lo, hi, at, width).where("price < limit_price")
    first = hits.groupBy("order_id").agg(F.min("trade_ts").alias("fill_ts"))
    return orders.join(first, "order_id", "left")


def summary(trades: DataFrame, day: str, ret: str) -> DataFrame:
    """Trades, mean, win rate, and the daily Sharpe ratio times sqrt(252)."""
    d = trades.groupBy(day).agg(F.sum(ret).alias("d"), F.count(ret).alias("n"), F.count_if(F.col(ret) > 0).alias("w"))
    return d.agg(F.sum("n").alias("trades"), (F.sum("d") / F.sum("n")).alias("mean"), (F.sum("w") / F.sum("n")).alias("win_rate"), (F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0)) * F.sqrt(F.lit(252.0))).alias("sharpe"))


#: Why a signal of a candidate is not traded. The first four come before the check of the open position's successors.
REASONS = ("missing_or_invalid_target_window", "missing_or_invalid_governed_entry", "invalid_local_direction", "overlap_existing_position", "delayed_entry_at_or_after_exit_or_missing", "missing_causal_beta", "unsupported_return_basis", "missing_benchmark_window", "missing_delayed_benchmark_entry")


def leg_cost(out_in: Column, side: Column, cost_bps: float, slippage_bps: float) -> Column:
    """Costs of a leg by its exit over its entry: prices slip against both trades, and the fee is on the prices that are paid."""
    slip, fee = slippage_bps / 1e4, cost_bps / 1e4
    return slip * (1 + out_in) + fee * ((1 + side * slip) + out_in * (1 - side * slip))


def candidate_replay(signals: DataFrame, bars: DataFrame, benchmark: DataFrame, delay_minutes: int = 0, cost_bps: float = 0.0, slippage_bps: float = 0.0) -> DataFrame:
    """Every signal with a status ("traded" or why not) and, where traded, its gross and net return with the hedge leg.

    signals: signal_id, security_id, decision_ts, entry_ts, entry_price, exit_ts, exit_price, direction (1, -1), basis (raw, benchmark_adjusted, beta_residual), beta, benchmark_entry_ts, benchmark_exit_ts, benchmark_exit_price. bars: security_id, ts, price. benchmark: ts, price.
    Prices after the delay come by as-of joins; only the rule of one open position a security is a pass in order, over
    rows that already know all other reasons."""
    from functools import reduce

    from tidemark.operators.joins import asof

    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) & (F.col(c) > 0)
    late = F.expr(f"INTERVAL {int(delay_minutes)} MINUTES")
    s = signals.withColumn("_from", F.col("entry_ts") + late).withColumn("_bfrom", F.col("benchmark_entry_ts") + late).withColumn("_one", F.lit(1))
    valid = bars.where(good("price")).select("security_id", F.col("ts").alias("_at"), F.col("ts").alias("_fill_ts"), F.col("price").alias("_fill"))
    s = asof(s, valid, ["security_id"], "_from", "_at", ["_fill_ts", "_fill"], forward=True)
    market = benchmark.where(good("price")).select(F.lit(1).alias("_one"), F.col("ts").alias("_at"), F.col("ts").alias("_bfill_ts"), F.col("price").alias("_bfill"))
    s = asof(s, market, ["_one"], "_bfrom", "_at", ["_bfill_ts", "_bfill"], forward=True, bucket=lambda t: F.to_date(t))
    known_beta = F.col("beta").isNotNull() & ~F.isnan("beta")
    ratio = F.when(F.col("basis") == "benchmark_adjusted", 1.0).when((F.col("basis") == "beta_residual") & known_beta, F.col("beta")).otherwise(0.0)
    s = s.withColumn("_ratio", ratio)
    hedged = F.col("_ratio") != 0
    never = lambda c: F.coalesce(c, F.lit(False))
    before = [(REASONS[0], F.col("exit_ts").isNull() | ~never(good("exit_price"))), (REASONS[1], F.col("entry_ts").isNull() | ~never(good("entry_price"))), (REASONS[2], ~never(F.col("direction").isin(1, -1)))]
    after = [
        (REASONS[4], ~never(F.col("_fill_ts") < F.col("exit_ts"))), (REASONS[5], (F.col("basis") == "beta_residual") & ~known_beta), (REASONS[6], ~never(F.col("basis").isin("raw", "benchmark_adjusted", "beta_residual"))),
        (REASONS[7], hedged & (F.col("benchmark_exit_ts").isNull() | ~never(good("benchmark_exit_price")))), (REASONS[8], hedged & ~never(F.col("_bfill_ts") < F.col("benchmark_exit_ts"))),
    ]
    pick = lambda tests: reduce(lambda c, t: c.when(t[1], t[0]), tests, F.when(F.lit(False), F.lit("")))
    s = s.withColumn("_before", pick(before)).withColumn("_after", pick(after))

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["decision_ts", "signal_id"])
        free, out = None, []
        for at, until, first, then in zip(pdf["decision_ts"], pdf["exit_ts"], pdf["_before"], pdf["_after"]):
            if first is not None:
                out.append(first)
            elif free is not None and at < free:
                out.append(REASONS[3])
            elif then is not None:
                out.append(then)
            else:
                out.append("traded")
                free = until
        return pdf[["signal_id"]].assign(status=out)

    status = s.select("security_id", "signal_id", F.col("decision_ts").cast("timestamp").alias("decision_ts"), F.col("exit_ts").cast("timestamp").alias("exit_ts"), "_before", "_after").groupBy("security_id").applyInPandas(admit, "signal_id long, status string")
    out_in, b_out_in = F.try_divide("exit_price", "_fill"), F.try_divide("benchmark_exit_price", "_bfill")
    hedge_gross = F.when(hedged, -F.col("direction") * F.col("_ratio") * (b_out_in - 1)).otherwise(0.0)
    hedge_cost = F.when(hedged, F.abs("_ratio") * leg_cost(b_out_in, -F.col("direction") * F.signum("_ratio"), cost_bps, slippage_bps)).otherwise(0.0)
    gross = F.col("direction") * (out_in - 1) + hedge_gross
    traded = F.col("status") == "traded"
    s = s.join(status, "signal_id").withColumn("gross", F.when(traded, gross)).withColumn("net", F.when(traded, gross - leg_cost(out_in, F.col("direction"), cost_bps, slippage_bps) - hedge_cost))
    return s.select("signal_id", "security_id", "status", F.when(traded, F.col("_fill_ts")).alias("fill_ts"), "gross", "net")


def independent_signals(signals: DataFrame, key: str = "symbol") -> DataFrame:
    """Signals (signal_id, strategy, symbol, signal_ts, planned_exit_ts, side) with a status: accepted, or why not.

    Against an open position of the symbol the other side is refused; without one, sides that disagree at one time are
    all refused; a strategy holds a symbol once. Order-dependent: one grouped pass a symbol."""
    schema = f"{key} string, signal_id long, status string"

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["signal_ts", "strategy", "signal_id"])
        open_: dict[str, tuple] = {}
        status = []
        for now, rows in pdf.groupby("signal_ts", sort=True):
            open_ = {k: v for k, v in open_.items() if v[0] > now}
            held = {side for _, side in open_.values()}
            sides = set(rows["side"])
            for strategy, until, side in zip(rows["strategy"], rows["planned_exit_ts"], rows["side"]):
                if held and side not in held:
                    status.append("conflicts_with_existing_position")
                elif not held and len(sides) > 1:
                    status.append("simultaneous_unprioritized_conflict")
                elif strategy in open_:
                    status.append("same_strategy_symbol_already_open")
                else:
                    open_[strategy] = (until, side)
                    status.append("accepted")
        return pdf[[key, "signal_id"]].assign(status=status)

    return signals.groupBy(key).applyInPandas(f, schema)
