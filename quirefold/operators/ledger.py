"""Quotas, reservations, leases and admission as folds over ordered events and as relations.

Money is integer micro-dollars. The limits on a participant and those on everyone hold at once, so reservations are a
fold over one ordered log of a billing period, which is read batch by batch; only the admitted jobs and running counts are
held. Everything that needs no such order is a plain aggregation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import GUARD, billing_period, billing_period_end


@dataclass(frozen=True)
class Policy:
    """The pilot's limits."""

    participants: int = 300
    global_micros: int = 60_000_000
    participant_micros: int = 200_000
    ocr_pages: int = 50
    characters: int = 5000
    office_files: int = 10
    global_queued: int = 20
    participant_queued: int = 1
    global_running: int = 2
    participant_running: int = 1
    queue_seconds: int = 300
    quote_seconds: int = 300
    quarantine_seconds: int = 600
    guard: int = GUARD


PILOT = Policy()
UNITS = ("ocr_pages", "characters", "office_files")
LEDGER_SCHEMA = "seq long, job_id string, participant string, action string, outcome string, state string, used_micros long, reserved_micros long, fence int"


class Ledger:
    """State of one billing period."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.jobs: dict[str, dict] = {}
        self.used: dict[str, int] = defaultdict(int)
        self.reserved: dict[str, int] = defaultdict(int)
        self.units: dict[tuple[str, str], int] = defaultdict(int)
        self.committed = 0  # used and reserved by everyone
        self.counts: dict[tuple[str, str | None], int] = defaultdict(int)  # jobs by state, of a participant and of everyone (None)

    def held(self, states: tuple[str, ...], participant: str | None = None) -> int:
        return sum(self.counts[state, participant] for state in states)

    def move(self, job: dict, state: str) -> None:
        for participant in {None, job["participant"]}:
            if job["state"] is not None:
                self.counts[job["state"], participant] -= 1
            self.counts[state, participant] += 1
        job["state"] = state

    def reserve(self, e: dict) -> str:
        p, limit = e["participant"], self.policy
        if (old := self.jobs.get(e["job_id"])) is not None:
            return "same" if old["fingerprint"] == e["fingerprint"] else "conflict"
        if e["maximum"] <= 0:
            return "invalid"
        if e["period_end"] - e["at"] <= limit.guard:
            return "busy"
        if self.committed + e["maximum"] > limit.global_micros:
            return "budget_exceeded"
        if self.used[p] + self.reserved[p] + e["maximum"] > limit.participant_micros:
            return "quota_exceeded"
        if any(self.units[p, u] + e[u] > getattr(limit, u) for u in UNITS):
            return "quota_exceeded"
        if self.held(("queued",)) >= limit.global_queued or self.held(("queued",), p) >= limit.participant_queued:
            return "busy"
        self.jobs[e["job_id"]] = {"participant": p, "state": None, "maximum": e["maximum"], "fingerprint": e["fingerprint"], "fence": 0, "lease_until": 0, "started": False, "enqueued_at": e["at"], "since": None, **{u: e[u] for u in UNITS}}
        self.move(self.jobs[e["job_id"]], "queued")
        self.reserved[p] += e["maximum"]
        self.committed += e["maximum"]
        for u in UNITS:
            self.units[p, u] += e[u]
        return "queued"

    def release(self, job: dict) -> None:
        self.reserved[job["participant"]] -= job["maximum"]
        self.committed -= job["maximum"]
        for u in UNITS:
            self.units[job["participant"], u] -= job[u]

    def act(self, e: dict) -> str:
        job, action = self.jobs.get(e["job_id"]), e["action"]
        if action == "reserve":
            return self.reserve(e)
        if job is None:
            return "invalid"
        if job["participant"] != e["participant"]:
            return "not_admitted"
        state, p = job["state"], job["participant"]
        if action == "claim":
            return self.claim(job, e["at"], e["lease"])
        if action == "started":
            if state != "running" or e["fence"] != job["fence"]:
                return "conflict"
            job["started"] = True
            return "ok"
        if action == "unknown":
            if state not in ("running", "needs_reconciliation"):
                return "conflict"
            self.move(job, "needs_reconciliation")
            job["since"] = job["since"] or e["at"]
            return "ok"
        if action == "cancel":
            if state == "cancelled":
                return "same"
            if state != "queued":
                return "conflict"
            self.release(job)
            self.move(job, "cancelled")
            return "ok"
        if action == "settle":
            if state == "settled":
                return "same" if job["actual"] == e["actual"] else "conflict"
            if state not in ("running", "needs_reconciliation"):
                return "conflict"
            if e["actual"] > job["maximum"]:
                return "invalid"
            self.reserved[p] -= job["maximum"]
            self.used[p] += e["actual"]
            self.committed += e["actual"] - job["maximum"]
            self.move(job, "settled")
            job["actual"] = e["actual"]
            return "ok"
        return "invalid"

    def claim(self, job: dict, now: int, lease: int) -> str:
        """A lease with a fencing number; one that ran out before the outside call is given anew, after it never."""
        limit, p = self.policy, job["participant"]
        if job["state"] == "running":
            if now < job["lease_until"]:
                return "busy"
            if job["started"]:
                self.move(job, "needs_reconciliation")
                job["since"] = job["since"] or now
                return "reconciliation_required"
        elif job["state"] == "queued":
            if now - job["enqueued_at"] > limit.queue_seconds:
                self.release(job)
                self.move(job, "cancelled")
                return "busy"
            slots = ("running", "needs_reconciliation")
            if self.held(slots) >= limit.global_running or self.held(slots, p) >= limit.participant_running:
                return "busy"
        else:
            return "reconciliation_required" if job["state"] == "needs_reconciliation" else "conflict"
        self.move(job, "running")
        job.update(fence=job["fence"] + 1, lease_until=now + lease)
        return "ok"


def run_ledger(events: DataFrame, policy: Policy = PILOT) -> DataFrame:
    """events: seq, at (epoch seconds), action, job_id, participant, maximum, the three units, fingerprint, lease, fence,
    actual. Periods are independent, each an ordered log: Spark deals and sorts them, a task reads its periods one after the
    other and holds one batch of rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, period = None, None
        for frame in batches:
            rows = []
            for e in frame.to_dict("records"):
                if ledger is None or e["period"] != period:
                    ledger, period = Ledger(policy), e["period"]
                outcome = ledger.act(e)
                job = ledger.jobs.get(e["job_id"], {})
                p = e["participant"]
                rows.append((e["seq"], e["job_id"], p, e["action"], outcome, job.get("state"), ledger.used[p], ledger.reserved[p], job.get("fence", 0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEDGER_SCHEMA.split(", ")])

    dated = events.withColumn("period", billing_period(F.col("at"))).withColumn("period_end", billing_period_end(F.col("at")))
    return dated.repartition("period").sortWithinPartitions("period", "seq").mapInPandas(fold, LEDGER_SCHEMA)


def usage(reservations: DataFrame, budget: int = PILOT.participant_micros) -> DataFrame:
    """participant, period, used, reserved, remaining."""
    used = F.coalesce(F.sum(F.when(F.col("state") == "settled", F.col("actual_micros"))), F.lit(0))
    held = F.coalesce(F.sum(F.when(F.col("state").isin("queued", "running", "needs_reconciliation"), F.col("maximum_micros"))), F.lit(0))
    return reservations.groupBy("participant", "period").agg(used.alias("used_micros"), held.alias("reserved_micros"), F.greatest(F.lit(0), budget - used - held).alias("remaining_micros"))


def running_counts(jobs: DataFrame) -> DataFrame:
    """participant, running, and running of everyone beside it."""
    slots = F.count_if(F.col("state").isin("running", "needs_reconciliation"))
    return jobs.groupBy("participant").agg(slots.alias("running")).withColumn("running_all", jobs.agg(slots).scalar())


def sweep(jobs: DataFrame, now: Column, policy: Policy = PILOT) -> DataFrame:
    """Adds outcome of a sweep at `now`: fresh, expired, active, lease_expired, requeued, reconcile, quarantined or final."""
    waited = now - F.col("enqueued_at") > policy.queue_seconds
    unknown = now - F.col("unknown_since") >= policy.quarantine_seconds
    outcome = (
        F.when(F.col("state") == "queued", F.when(waited, F.lit("expired")).otherwise(F.lit("fresh")))
        .when(F.col("state") == "running", F.when(now < F.col("lease_until"), F.lit("active")).when(F.col("external_started"), F.lit("lease_expired")).otherwise(F.lit("requeued")))
        .when(F.col("state") == "needs_reconciliation", F.when(F.coalesce(unknown, F.lit(False)), F.lit("quarantined")).otherwise(F.lit("reconcile")))
        .otherwise(F.lit("final"))
    )
    return jobs.withColumn("outcome", outcome)


def admissions(requests: DataFrame, most: int = PILOT.participants) -> DataFrame:
    """participant, first_at, place, admitted: the first `most` in order of their first request; asking again changes
    nothing. Only the admitted have a place, so nothing is ranked beyond the top."""
    first = requests.groupBy("participant").agg(F.min("at").alias("first_at"))
    top = first.orderBy("first_at", "participant").limit(most)
    ranked = top.select("participant", F.row_number().over(Window.orderBy("first_at", "participant")).alias("place"))
    return first.join(F.broadcast(ranked), "participant", "left").withColumn("admitted", F.col("place").isNotNull())  # `most` rows


def finalize_status(quotes: DataFrame, now: Column, policy_version: str, max_ratio: int = 100) -> DataFrame:
    """Adds status: expired, invalid, changed or ok, tested in this order."""
    status = (
        F.when((now >= F.col("expires_at")) | (F.col("policy_version") != policy_version), F.lit("expired"))
        .when((F.col("bytes") > F.col("max_bytes")) | (F.col("expanded_bytes") > F.greatest(F.col("bytes"), F.lit(1)) * max_ratio), F.lit("invalid"))
        .when((F.col("found_mime") != F.col("mime")) | (F.col("found_units") != F.col("units")) | (F.col("found_maximum") > F.col("maximum")), F.lit("changed"))
        .otherwise(F.lit("ok"))
    )
    return quotes.withColumn("status", status)


def byte_range(content: Column, first: Column, length: Column) -> Column:
    return F.substring(content, first + 1, length)


def monthly_totals(events: DataFrame, at: str = "at", value: str = "value") -> DataFrame:
    """period, n, total, late (events inside the guard at the month's end)."""
    end = billing_period_end(F.col(at))
    return events.groupBy(billing_period(F.col(at)).alias("period")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(end - F.col(at) <= GUARD).alias("late"))


def inactive_sessions(events: DataFrame, now: Column, idle: int = 1800) -> DataFrame:
    """user_id, last_at, expired."""
    last = events.groupBy("user_id").agg(F.max("at").alias("last_at"))
    return last.withColumn("expired", now - F.col("last_at") >= idle)


def sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    """user_id, session_no, first_at, last_at, n: runs of events less than `gap` seconds apart."""
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    fresh = F.coalesce(F.col("at") - F.lag("at").over(order) >= gap, F.lit(True)).cast("int")
    numbered = events.withColumn("session_no", F.sum(fresh).over(order))
    return numbered.groupBy("user_id", "session_no").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))
