"""Billing months in a fixed time zone, from epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
#: No new work in the last seconds of a month.
GUARD = 900


def _local(epoch: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def billing_period(epoch: Column, zone: str = ZONE) -> Column:
    return F.date_format(_local(epoch, zone), "yyyy-MM")


def billing_period_end(epoch: Column, zone: str = ZONE) -> Column:
    """Epoch seconds at which the next local month begins. The session's time zone must be UTC."""
    following = F.add_months(F.trunc(_local(epoch, zone), "month"), 1).cast("timestamp")
    return F.unix_seconds(F.to_utc_timestamp(following, zone))


def in_guard(epoch: Column, zone: str = ZONE, guard: int = GUARD) -> Column:
    return billing_period_end(epoch, zone) - epoch <= guard
