"""Instants, local clocks and windows.  All instants are UTC; windows are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_to_ts(text: Column) -> Column:
    """Unix seconds that arrived as text; anything but an integer gives NULL."""
    return F.timestamp_seconds(F.when(text.rlike(r"^-?\d+$"), text).try_cast("long"))


def iso_to_ts(text: Column) -> Column:
    """ISO 8601, with or without an offset (none means UTC)."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))


def add_seconds(ts: Column, seconds) -> Column:
    sec = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros(F.unix_micros(ts) + F.round(sec * 1000000).cast("long"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1000000.0)


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("long")


def in_window(ts: Column, end: Column, seconds) -> Column:
    return (ts >= add_seconds(end, -1.0 * seconds if not isinstance(seconds, Column) else -seconds)) & (ts < end)


def local(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts, zone)


def minute_of_day(local_ts: Column) -> Column:
    return F.hour(local_ts) * 60 + F.minute(local_ts)


def clock(text: str) -> int:
    h, _, m = text.partition(":")
    return int(h) * 60 + int(m or 0)


def local_moment(day: Column, minute, zone: Column) -> Column:
    """The instant at which a local day reaches a minute of its day."""
    m = minute if isinstance(minute, Column) else F.lit(minute)
    wall = F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + m.cast("long") * 60)
    return F.to_utc_timestamp(wall, zone)


def next_contact_window(ts: Column, zone: Column, opens: int = 480, closes: int = 1140) -> Column:
    loc = local(ts, zone)
    m = minute_of_day(loc)
    day = F.when(m < opens, F.to_date(loc)).otherwise(F.date_add(F.to_date(loc), 1))
    return F.when((m >= opens) & (m < closes), ts).otherwise(local_moment(day, opens, zone))


def days_to_day_of_month(local_day: Column, target: Column) -> Column:
    ahead = target - local_day
    return F.when(ahead >= 0, ahead).otherwise(ahead + 30)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1))), F.lit(900.0)).cast("long")


def reservation_tier(horizon_seconds: Column) -> Column:
    return F.when(horizon_seconds <= 900, "hard").otherwise("soft")


# ---- promises ------------------------------------------------------------------------------------
def promise_horizon_days(made: Column, due: Column) -> Column:
    """Whole days, half-even rounding, at least one."""
    return F.greatest(F.bround(seconds_between(due, made) / 86400.0, 0).cast("long"), F.lit(1).cast("long"))


def promise_deadline(due: Column, grace_hours: float) -> Column:
    return add_seconds(due, grace_hours * 3600)


def promise_observed_days(made: Column, horizon: Column, deadline: Column, until: Column, censored: Column) -> Column:
    end = F.least(until, deadline)
    elapsed = F.floor(seconds_between(end, made) / 86400.0).cast("long")
    return F.greatest(F.least(elapsed, horizon), F.when(censored, F.lit(0)).otherwise(F.lit(1)).cast("long"))
