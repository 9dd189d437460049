"""Streaming forms of the rate and budget analytics; extras beside the batch ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rates(events: DataFrame, ts: str = "ts", width: str = "60 seconds", step: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """Events by sliding window and kind; rows later than the watermark are left out."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width, step), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
    )


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """W4 over time: a user's events merged while the gap between them is short."""
    return (
        events.withWatermark(ts, late)
        .groupBy("user_id", F.session_window(ts, gap))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def budgets(spending: DataFrame, soft: float, hard: float) -> DataFrame:
    """Each user's running cost as keyed state: user_id, spent, state, whenever rows arrive."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        for pdf in batches:
            spent += float(pdf["value"].sum())
        state.update((spent,))
        name = "stop" if spent >= hard else "mapping" if spent >= soft else "all"
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "state": [name]})

    return spending.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, spent double, state string", "spent double", "update", GroupStateTimeout.NoTimeout)
