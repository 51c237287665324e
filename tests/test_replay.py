"""Replays with conflicts, delays and hedges against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import execution as X

T0 = datetime(2024, 1, 1)


def test_independent_signals(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice("ab"), rnd.choice(["x", "y"]), T0 + timedelta(hours=rnd.randrange(60)), rnd.choice([-1, 1])) for k in range(200)]
    rows = [(k, st, sy, at, at + timedelta(hours=random.Random(k).randrange(1, 9)), side) for k, st, sy, at, side in rows]
    want = {}
    for symbol in ("x", "y"):
        open_ = []  # (strategy, until, side)
        for now in sorted({r[3] for r in rows if r[2] == symbol}):
            open_ = [o for o in open_ if o[1] > now]
            pending = sorted((r for r in rows if r[2] == symbol and r[3] == now), key=lambda r: (r[1], r[0]))
            if open_:
                for r in pending:
                    if r[5] != open_[0][2]:
                        want[r[0]] = "conflicts_with_existing_position"
                pending = [r for r in pending if r[0] not in want]
            elif len({r[5] for r in pending}) > 1:
                want |= {r[0]: "simultaneous_unprioritized_conflict" for r in pending}
                pending = []
            for r in pending:
                if any(o[0] == r[1] for o in open_):
                    want[r[0]] = "same_strategy_symbol_already_open"
                else:
                    want[r[0]] = "accepted"
                    open_.append((r[1], r[4], r[5]))
    df = spark.createDataFrame(rows, "signal_id long, strategy string, symbol string, signal_ts timestamp, planned_exit_ts timestamp, side int")
    assert {r.signal_id: r.status for r in X.independent_signals(df).collect()} == want
    assert len(set(want.values())) == 4


def test_candidate_replay(spark):
    rnd = random.Random(2)
    bars = [(s, T0 + timedelta(minutes=m), None if rnd.random() < 0.1 else rnd.choice([0.0, -1.0]) if rnd.random() < 0.1 else 50 + rnd.random()) for s in (1, 2) for m in range(0, 600, 7)]
    market = [(T0 + timedelta(minutes=m), 100 + rnd.random()) for m in range(0, 560, 11)]
    rows = []
    for k in range(300):
        at = T0 + timedelta(minutes=rnd.randrange(590))
        until = None if rnd.random() < 0.04 else at + timedelta(minutes=rnd.randrange(1, 60))
        bad = lambda x: rnd.choice([None, float("nan"), 0.0, -5.0]) if rnd.random() < 0.05 else x
        rows.append((k, rnd.choice([1, 2]), at, None if rnd.random() < 0.04 else at + timedelta(minutes=1), bad(50.0), until, bad(51.0), rnd.choice([1, -1, 1, 0]) if rnd.random() < 0.2 else 1, rnd.choice(["raw", "benchmark_adjusted", "beta_residual", "odd"]) if rnd.random() < 0.9 else None, rnd.choice([0.5, -0.3, None, float("nan"), 0.0]), at, until, bad(101.0)))
    schema = "signal_id long, security_id long, decision_ts timestamp, entry_ts timestamp, entry_price double, exit_ts timestamp, exit_price double, direction int, basis string, beta double, benchmark_entry_ts timestamp, benchmark_exit_ts timestamp, benchmark_exit_price double"
    ok = lambda x: x is not None and x == x and x > 0
    delay = timedelta(minutes=3)

    def cost(side, paid_in, paid_out):
        a, b = paid_in * (1 + side * 0.0002), paid_out * (1 - side * 0.0002)
        return side * (paid_out - paid_in) / paid_in - (side * (b - a) / paid_in - 0.0003 * (a + b) / paid_in)

    want, free = {}, {}
    for k, s, at, entry, ep, until, xp, side, basis, beta, b0, b1, bx in sorted(rows, key=lambda r: (r[2], r[0])):
        first = min(((t, p) for q, t, p in bars if q == s and ok(p) and entry is not None and t >= entry + delay), default=None)
        ratio = 1.0 if basis == "benchmark_adjusted" else beta if basis == "beta_residual" and beta is not None and beta == beta else 0.0
        hedge = min(((t, p) for t, p in market if t >= b0 + delay), default=None)
        if until is None or not ok(xp):
            status = X.REASONS[0]
        elif entry is None or not ok(ep):
            status = X.REASONS[1]
        elif side not in (1, -1):
            status = X.REASONS[2]
        elif s in free and at < free[s]:
            status = X.REASONS[3]
        elif first is None or first[0] >= until:
            status = X.REASONS[4]
        elif basis == "beta_residual" and (beta is None or beta != beta):
            status = X.REASONS[5]
        elif basis not in ("raw", "benchmark_adjusted", "beta_residual"):
            status = X.REASONS[6]
        elif ratio and (b1 is None or not ok(bx)):
            status = X.REASONS[7]
        elif ratio and (hedge is None or hedge[0] >= b1):
            status = X.REASONS[8]
        else:
            status, free[s] = "traded", until
        gross = net = None
        if status == "traded":
            gross = side * (xp / first[1] - 1) - (side * ratio * (bx / hedge[1] - 1) if ratio else 0.0)
            net = gross - cost(side, first[1], xp) - (abs(ratio) * cost(-side if ratio > 0 else side, hedge[1], bx) if ratio else 0.0)
        want[k] = (status, None if gross is None else pytest.approx(gross), None if net is None else pytest.approx(net))
    got = X.candidate_replay(spark.createDataFrame(rows, schema), spark.createDataFrame(bars, "security_id long, ts timestamp, price double"), spark.createDataFrame(market, "ts timestamp, price double"), 3, 3.0, 2.0)
    assert {r.signal_id: (r.status, r.gross, r.net) for r in got.collect()} == want
    assert len({s for s, *_ in want.values()}) >= 9
