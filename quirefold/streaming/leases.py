"""Leases, sessions and months over streams: event-time state with watermarks and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_OUT = "job_id string, at_seconds long, outcome string, fence int"
LEASE_STATE = "status string, fence int, lease_until long, started boolean"


def lease_stream(events: DataFrame, lease: int = 120, lateness: str = "1 minute", remembered: int = 86_400) -> DataFrame:
    """events: ts, job_id, action (claim, started, finish). Outcomes of each action, and of leases that run out: a job
    that hadn't started its outside call is requeued with a higher fence, one that had needs reconciliation. A settled
    job is forgotten after `remembered` seconds without events, so that state doesn't grow with all jobs ever seen."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, fence, until, started = state.get if state.exists else ("queued", 0, 0, False)
        rows: list[tuple] = []

        def expire(now: int) -> None:
            nonlocal status, fence, started
            if status == "running" and now >= until:
                status = "needs_reconciliation" if started else "queued"
                fence += not started
                rows.append((key[0], until, "reconcile" if started else "requeued", fence))
                started = False

        if state.hasTimedOut and status == "settled":
            state.remove()
            return
        if state.hasTimedOut:
            expire(until)
        else:
            for row in pd.concat(list(frames)).sort_values("ts").itertuples():
                now = int(row.ts.timestamp())
                expire(now)
                if row.action == "claim" and status == "queued":
                    status, fence, until, started = "running", fence + 1, now + lease, False
                    rows.append((key[0], now, "leased", fence))
                elif row.action == "claim":
                    rows.append((key[0], now, "busy" if status == "running" else status, fence))
                elif row.action == "started" and status == "running":
                    started = True
                elif row.action == "finish" and status == "running":
                    status = "settled"
                    rows.append((key[0], now, "settled", fence))
        state.update((status, fence, until, started))
        if status in ("running", "settled"):
            ends = until if status == "running" else rows[-1][1] + remembered if rows else until + remembered
            state.setTimeoutTimestamp(max(ends * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["job_id", "at_seconds", "outcome", "fence"])

    return events.withWatermark("ts", lateness).groupBy("job_id").applyInPandasWithState(step, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """user_id, first_at, last_at, n for each run of activity; a session is final once the watermark has passed it."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closes_at"), "n")


def outcome_stream(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and mean duration of outcomes by tumbling window."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("from_at"), "event_type", "n", "mean")
