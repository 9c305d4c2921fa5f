"""Forbidden moments as bits against asking each rule at each of the 33 moments."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import times
from dunlin.operators import intervals as I
from dunlin.operators import rules as R
from dunlin.sources import ruleset
from dunlin.sources.ruleset import Rule

EXTRA = [Rule("X-FORCE", "RESERVED", ["silent"], None, "policy_choice", "in_force", "contact_frequency", {"window_hours": 1, "max_contacts": 2}, "BLOCK", in_force_from="2024-03-10"),
         Rule("X-NIGHT", "RESERVED", ["silent"], None, "policy_choice", "in_force", "contact_window", {"open": "00:05", "close": "23:55"}, "BLOCK"),
         Rule("X-WEEK", "RESERVED", ["silent"], None, "policy_choice", "in_force", "blocked_days", {"weekdays": [0, 5, 6], "include_bank_holidays": False}, "BLOCK")]


def contexts(spark, n=400):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        # the middles of clock changes, midnights, openings, and any time
        at = rng.choice([dt.datetime(2024, 3, 10, 7, 0), dt.datetime(2024, 11, 3, 6, 0), dt.datetime(2024, 3, 31, 1, 0), dt.datetime(2024, 3, 9, 18, 30), dt.datetime(2024, 3, 10, 0, 0),
                         dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 13, 30)]) + dt.timedelta(seconds=rng.choice([0, 0, 1, -1, 56, 450, -450, 899, -900, rng.randint(-1200, 1200)]), microseconds=rng.choice([0, 250000, 1]))
        near = lambda: at + dt.timedelta(seconds=rng.choice([0, 1, -1, -3600, -86400, -86400 * 30, rng.randint(-1000, 1000), rng.randint(-90000, 900)]) + rng.choice([0, rng.randint(-950, 950)]))  # noqa: B023, E731
        con = [(near(), rng.choice(["voice", "sms", "email", "whatsapp", "push"]), rng.choice(["connected", "replied", "sent", None])) for _ in range(rng.randint(0, 9))]
        ret = [near() for _ in range(rng.choice([0, 1, 3, 16, 18]))]
        flags = {f: rng.choice([True, False, False, None]) for f in FLAGS}
        ends = {f: rng.choice([None, near(), near() - dt.timedelta(hours=rng.choice([0, 72]))]) for f in UNTIL}
        rows.append((f"c{i}", at, rng.choice([None, "UTC", "Asia/Kolkata", "America/New_York", "Europe/Berlin", "Asia/Kathmandu"]), rng.choice([None, 1260, 0, 600, 1439]), rng.choice([None, 420, 0, 1320, 30]),
                     rng.choice([None, [], [at.date()], [at.date() + dt.timedelta(days=1)]]), rng.choice([None, near(), near() - dt.timedelta(hours=24)]), rng.choice([None, near()]), con, ret, {**flags, **ends}))
    kind = ", ".join([f"{f}:boolean" for f in FLAGS] + [f"{f}:timestamp" for f in UNTIL])
    return spark.createDataFrame(rows, "claim_id string, at timestamp, tz_zone string, quiet_start_min int, quiet_end_min int, bank_holidays array<date>, predebit_notice_at timestamp, certificate_valid_until timestamp, "
                                       f"contacts array<struct<at_ts:timestamp,channel:string,outcome:string>>, retries array<timestamp>, flags struct<{kind}>")


FREEZE = [r for r in ruleset.load() if r.check == "freeze_until"]
FLAGS = sorted({r.params["flag"] for r in FREEZE})
UNTIL = sorted({r.params["until_field"] for r in FREEZE})


def test_every_moving_rule_at_every_moment(spark):
    rules = [r for r in ruleset.load() if r.check in R.MOVING] + EXTRA
    assert {r.check for r in rules} == set(R.MOVING)
    df = contexts(spark).cache()
    at = F.col("at")

    def asked(rule, m):
        return F.coalesce(R._in_force(rule, m, R.check(rule, m)[0]), F.lit(True))
    for k in range(0, len(rules), 3):
        some = rules[k:k + 3]
        cols = [I.forbidden(r, at, lambda m, r=r: asked(r, m)).alias(f"b{i}") for i, r in enumerate(some)]
        each = [F.array(*[asked(r, times.add_seconds(at, j * 56.25)) for j in range(-16, 17)]).alias(f"w{i}") for i, r in enumerate(some)]
        for row in df.select("claim_id", "at", *cols, *each).collect():
            for i, r in enumerate(some):
                got = [bool(row[f"b{i}"] >> j & 1) for j in range(33)]
                assert got == row[f"w{i}"], (r.id, row["claim_id"], row["at"])


def test_runs_of_bits(spark):
    rng = random.Random(1)
    pairs = [tuple(sorted(rng.choice([rng.randint(-2_000_000_000, 2_000_000_000), 56_250_000 * rng.randint(-18, 18) + rng.choice([0, 1, -1])]) for _ in range(2))) for _ in range(300)]
    for r in spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", I.bits(F.col("lo"), F.col("hi")).alias("b")).collect():
        assert r["b"] == sum(1 << (j + 16) for j in range(-16, 17) if r["lo"] <= j * 56_250_000 < r["hi"])
    assert dims.CONTACT_CHANNELS
