"""Streaming forms: event-time windows with watermarks, and bounded-state history. The same functions take batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; late rows beyond the watermark are dropped on a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def prior_means(events: DataFrame, keep: int) -> DataFrame:
    """Each row with the mean of its key's last `keep` values, from bounded state (a stream's rows of one key come in order)."""

    def f(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            means = []
            for v in pdf["value"]:
                means.append(sum(held) / len(held) if held else None)
                held = [*held, float(v)][-keep:]
            yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "prior_mean": means})
        state.update((held,))

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(f, "user_id long, event_id long, prior_mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)
