"""Forbidden intervals of the rules around a moment, as bits.

A certificate may hold up to a quarter hour each way, and the search for its ends only looks at sixteenths of that: 33
moments.  What a rule forbids near a moment is a union of intervals that can be read off its sorted events, clocks and
limits, so no rule is asked 33 times: each interval becomes a run of bits, unions are ORs of 64-bit numbers, and the
search is a few tests of bits.  Local clocks are taken as running evenly; where the zone's offset changes within the
half hour, and only there, the local checks are asked moment by moment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import times
from dunlin.sources.ruleset import Rule

SLOTS, STEP_US = 16, 56_250_000
ALL, NONE = (1 << (2 * SLOTS + 1)) - 1, 0
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Checks that look at the local clock.
LOCAL = ("contact_window", "quiet_hours", "blocked_days")


def _below(us: Column) -> Column:
    """Bits of the moments that come before an offset from the middle one, in microseconds."""
    j = F.greatest(F.lit(-SLOTS), F.least(F.lit(SLOTS + 1), F.ceil(us / STEP_US)))
    return F.call_function("shiftleft", F.lit(1).cast("long"), (j + SLOTS).cast("int")) - 1


def bits(lo: Column | None, hi: Column | None) -> Column:
    """Moments in [lo, hi), offsets in microseconds; None is without end."""
    upto = F.lit(ALL) if hi is None else _below(hi)
    return upto if lo is None else F.greatest(upto - _below(lo), F.lit(0))       # runs of low bits: their difference is the run between


def _mask(test: Column, when_null: int) -> Column:
    return F.when(test, ALL).when(test.isNull(), when_null).otherwise(NONE).cast("long")


def _either(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.coalesce(b, F.lit(0).cast("long"))))


def _counted(moments: Column, at_us: Column, n: int, reach_us: int) -> Column:
    """While the n-th newest event is within reach: between the n-th of n neighbours and the end of the first one's reach."""
    ordered = F.transform(F.sort_array(moments), lambda t: F.unix_micros(t) - at_us)
    return _either(F.transform(ordered, lambda x, i: bits(F.get(ordered, i + (n - 1)) + 1, x + (reach_us + 1))))


def _cooling(events: Column, at_us: Column, hours: float, pred) -> Column:
    mine = F.filter(events, lambda e: pred(e) & e["at_ts"].isNotNull())
    return _either(F.transform(mine, lambda e: bits(F.unix_micros(e["at_ts"]) - at_us + 1, F.unix_micros(e["at_ts"]) - at_us + int(hours * HOUR))))


def _clock(opens_us: Column, closes_us: Column, now_us: Column) -> Column:
    """Moments whose local clock is in [opens, closes) of any day, closes beyond midnight included."""
    out = F.lit(0).cast("long")
    for day in (-1, 0, 1):
        out = out.bitwiseOR(bits(opens_us + day * DAY - now_us, closes_us + day * DAY - now_us))
    return out


def _local(rule: Rule, at: Column) -> Column:
    p, zone = rule.params, F.col("tz_zone")
    here = times.local(at, zone)
    today = F.to_date(here)
    now = F.unix_micros(here) - F.unix_date(today).cast("long") * DAY
    if rule.check == "contact_window":
        lo, hi = times.clock(p.get("open", "08:00")), times.clock(p.get("close", "19:00"))
        return F.when(zone.isNull(), ALL).otherwise(F.lit(ALL) - _clock(F.lit(lo * 60_000_000), F.lit(hi * 60_000_000), now))
    if rule.check == "quiet_hours":
        s, e = F.col("quiet_start_min").cast("long") * 60_000_000, F.col("quiet_end_min").cast("long") * 60_000_000
        return F.when(s.isNull(), NONE).when(zone.isNull(), ALL).otherwise(_clock(s, F.when(e.isNull(), DAY).when(s > e, e + DAY).otherwise(e), now))
    days = p.get("weekdays", [])

    def blocked(day: Column) -> Column:
        hit = F.weekday(day).isin(*days) if days else F.lit(False)
        return F.coalesce(hit | F.array_contains("bank_holidays", day) if p.get("include_bank_holidays", True) else hit, F.lit(True))
    out = F.lit(0).cast("long")
    for k in (-1, 0, 1):
        out = out.bitwiseOR(F.when(blocked(F.date_add(today, k)), bits(F.lit(k * DAY) - now, F.lit((k + 1) * DAY) - now)).otherwise(NONE))
    return F.when(zone.isNull(), ALL).otherwise(out)


def _shifts(at: Column) -> Column:
    """Whether the local clock jumps within the half hour."""
    offset = lambda m: F.unix_micros(times.local(m, F.col("tz_zone"))) - F.unix_micros(m)
    return F.coalesce(offset(times.add_seconds(at, -900.0)) != offset(times.add_seconds(at, 900.0)), F.lit(False))


def forbidden(rule: Rule, at: Column, asked: Callable[[Column], Column]) -> Column:
    """The moments at which a moving rule is violated; `asked` is the rule's own answer at one moment, true if it has none."""
    p, c, at_us = rule.params, rule.check, F.unix_micros(at)
    rel = lambda t: F.unix_micros(t) - at_us
    if c == "freeze_until":
        end = F.col("flags")[p["until_field"]]
        mask = F.when(F.coalesce(F.col("flags")[p["flag"]], F.lit(True)), F.when(end.isNull(), ALL).otherwise(bits(None, rel(end) + int(p.get("extra_hours", 0) * HOUR)))).otherwise(NONE)
    elif c == "attempt_budget":
        mask = _counted(F.col("retries"), at_us, p["max_attempts"], int(p["window_days"] * DAY))
    elif c == "attempts_per_day":
        mask = _counted(F.col("retries"), at_us, p["max_per_day"], DAY)
    elif c == "predebit_notice_lead":
        mask = F.when(F.col("predebit_notice_at").isNull(), ALL).otherwise(bits(None, rel(F.col("predebit_notice_at")) + int(p["hours"] * HOUR)))
    elif c == "certificate_window":
        mask = F.when(F.col("certificate_valid_until").isNull(), NONE).otherwise(bits(rel(F.col("certificate_valid_until")) + 1, None))
    elif c == "channel_cooldown":
        outs = p.get("outcomes")
        mask = _cooling(F.col("contacts"), at_us, p["hours"], (lambda e: (e["channel"] == p["channel"]) & e["outcome"].isin(*outs)) if outs else (lambda e: e["channel"] == p["channel"]))
    elif c == "cross_channel_cooldown":
        mask = _cooling(F.col("contacts"), at_us, p["hours"], lambda e: e["channel"].isin(*dims.CONTACT_CHANNELS))
    elif c == "contact_frequency":
        touches = F.filter("contacts", lambda e: e["channel"].isin(*dims.CONTACT_CHANNELS))
        mask = _counted(F.transform(touches, lambda e: e["at_ts"]), at_us, p["max_contacts"], int(p["window_hours"] * HOUR))
    elif c in LOCAL:
        each = F.transform(F.sequence(F.lit(-SLOTS), F.lit(SLOTS)), lambda j: F.when(asked(times.add_seconds(at, j * (STEP_US / 1e6))), F.call_function("shiftleft", F.lit(1).cast("long"), (j + SLOTS).cast("int"))).otherwise(0))
        mask = F.when(_shifts(at), _either(each)).otherwise(_local(rule, at))
    else:
        raise ValueError(f"no intervals for {c}")
    if rule.in_force_from and c not in LOCAL:
        mask = mask.bitwiseAND(bits(rel(F.lit(rule.in_force_from).cast("timestamp")), None))
    elif rule.in_force_from:
        mask = F.when(_shifts(at), mask).otherwise(mask.bitwiseAND(bits(rel(F.lit(rule.in_force_from).cast("timestamp")), None)))
    return F.coalesce(mask.cast("long"), F.lit(ALL))
