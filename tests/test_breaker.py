"""The composed breaker against a loop over rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from dunlin.operators import breaker as B
from dunlin.session import scratch_path
from dunlin.streaming import jobs as J

C = 300_000_000


def by_hand(rows, threshold, cooldown=C):
    fails, opened, out = 0, None, []
    for at, ok in rows:
        if opened is not None and at - opened < cooldown:
            continue
        if ok:
            fails, opened = 0, None
            continue
        fails += 1
        if fails >= threshold and opened is None:
            opened = at
            out.append(at)
    return out


def flapping(seed, n, step_s, fail):
    rng = random.Random(seed)
    at, out = 0, []
    for _ in range(n):
        at += rng.choice([0, 1, step_s]) * 1_000_000
        out.append((at, rng.random() >= fail))
    return out


def test_tables_compose(monkeypatch):
    for seed in range(300):
        rng = random.Random(seed)
        rows, threshold = flapping(seed, rng.randint(1, 400), rng.choice([1, 20, 200]), rng.choice([0.5, 0.8, 0.95])), rng.choice([1, 2, 3])
        k, last_ok, found = 0, B.NEVER, []
        for at, ok in rows:
            k, last_ok = (0, at) if ok else (k + 1, last_ok)
            if not ok and k == threshold:
                found.append((at, last_ok))
        t, s = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
        want = by_hand(rows, threshold)
        assert B.openings(t, s, B.NEVER, C)[0] == want
        hears, got = B.NEVER, []
        size = rng.randint(1, 9)
        for a in range(0, len(t), size):
            trips, end = B.openings(t[a:a + size], s[a:a + size], hears, C)
            got += trips
            hears = B.compose(hears, *B.step_table(t[a:a + size], s[a:a + size], C))
            assert hears == end
        assert got == want


def test_batch_and_any_split_into_calls(spark, monkeypatch):
    monkeypatch.setattr(B, "STRETCH", 3)
    rows = [(source, f"{source}{i:05d}", at, ok) for source, seed, step, fail in (("hot", 1, 30, 0.9), ("cold", 2, 400, 0.97), ("fine", 3, 60, 0.2))
            for i, (at, ok) in enumerate(flapping(seed, 2500 if source == "hot" else 400, step, fail))]
    schema = "source string, event_id string, at_us long, succeeded boolean"
    for threshold, cuts in ((20, [0, 1 << 60]), (3, [0, 9_000_000_000, 9_000_000_001, 1 << 60])):
        want = sorted((s, t) for s in ("hot", "cold", "fine") for t in by_hand([(r[2], r[3]) for r in rows if r[0] == s], threshold))
        assert want and {s for s, _ in want} >= {"hot", "cold"}
        got, state = [], None
        for lo, hi in zip(cuts, cuts[1:]):
            part = spark.createDataFrame([r for r in rows if lo <= r[2] < hi], schema)
            trips, state = B.breaker_trips(part, threshold, C, state, split=320)
            got += [tuple(r) for r in trips.collect()]
            state = spark.createDataFrame(state.select("source", "run", "ok_us", "hears_us").collect(), B.STATE)
        assert sorted(got) == want


def test_no_events(spark):
    trips, state = B.breaker_trips(spark.createDataFrame([], "source string, event_id string, at_us long, succeeded boolean"), 20, C)
    assert trips.collect() == [] and state.collect() == []


def test_a_killed_stream_goes_on_with_the_same_rows(spark):
    rows = [(i, at, ok) for i, (at, ok) in enumerate(flapping(9, 600, 40, 0.85))]
    df = spark.createDataFrame(rows, "event_id long, us long, succeeded boolean").select("event_id", F.lit("pgw").alias("source"), F.timestamp_micros("us").alias("at_ts"), "succeeded")
    want = by_hand([(at, ok) for _, at, ok in rows], 5)
    folder, state, out = scratch_path(spark, "in"), scratch_path(spark, "state"), scratch_path(spark, "out")
    cut = rows[300][1]
    got = None
    for part in (df.where(F.unix_micros("at_ts") < cut), df.where(F.unix_micros("at_ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(folder)
        got = J.source_breaker(J.stream(spark, folder, df.schema, 1), out, threshold=5, state=state)
    assert sorted(r["tripped_us"] for r in got.collect()) == want and want
