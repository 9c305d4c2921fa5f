"""Streaming state per key: old keys leave, splits of the input agree, a restarted stream goes on."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dunlin.session import scratch_path
from dunlin.streaming import jobs as J
from dunlin.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


def account_events(spark, seed=3, hot=400):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        day = rng.choice([0, 1, 2, 20, 21, 22])
        rows.append((f"acct_{rng.randint(0, 11)}", f"e{k}", rng.choice(["a", "b"]), T0 + dt.timedelta(days=day, minutes=rng.randint(0, 600)), rng.random() < 0.5))
    rows += [("acct_hot", f"h{k}", "a", T0 + dt.timedelta(days=22, seconds=k // 3), k % 4 == 0) for k in range(hot)]      # ties in time
    rows += [("acct_old", "o1", "a", T0, False), ("acct_old", "o2", "a", T0 + dt.timedelta(hours=1), True)]
    return spark.createDataFrame(rows, "account_ref string, event_id string, source string, event_ts timestamp, succeeded boolean"), rows


def by_hand(rows):
    out = {}
    for account in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == account]
        last = max(mine, key=lambda r: (r[3], r[2], r[1]))
        out[account] = (last[1], last[4], sum(not r[4] for r in mine), len(mine))
    return out


def totals(parts):
    return {r["account_ref"]: (r["last"]["event_id"], r["last"]["succeeded"], r["failed_attempts"], r["events"]) for r in keyed.account_totals(parts).collect()}


def test_accounts_in_any_split_and_with_any_memory(spark):
    df, rows = account_events(spark)
    want = by_hand(rows)
    for files, per, idle in [(1, 1, 24 * 90), (6, 2, 0.01)]:      # with a short memory keys are forgotten and come back
        s = J.stream(spark, J.land_in_order(df, "accounts", "event_ts", files), df.schema, per)
        parts = J.updates(keyed.account_state(s, late="1 day", idle_hours=idle, salts=4), ["account_ref", "salt", "epoch"], "accounts")
        assert totals(parts) == want, (files, per, idle)


def test_idle_keys_leave_the_state(spark):
    df, _ = account_events(spark)
    left = {}
    for idle in (24, 24 * 365):
        state = scratch_path(spark, "state")
        s = J.stream(spark, J.land_in_order(df, "accounts", "event_ts", 6), df.schema, 1)
        J.updates(keyed.account_state(s, late="1 hour", idle_hours=idle, salts=2), ["account_ref", "salt", "epoch"], "accounts", state)
        store = spark.read.format("statestore").option("path", state).option("stateVarName", "fold").load()
        left[idle] = {r[0] for r in store.select("key.account_ref").distinct().collect()}
    assert "acct_old" in left[24 * 365] and "acct_old" not in left[24] and "acct_hot" in left[24]


def test_a_restarted_stream_goes_on(spark):
    df, rows = account_events(spark)
    folder, state, out = scratch_path(spark, "in"), scratch_path(spark, "state"), scratch_path(spark, "out")
    cut = T0 + dt.timedelta(days=20)
    schema = None
    for part in (df.where(F.col("event_ts") < cut), df.where(F.col("event_ts") >= cut)):       # the query ends and is started again
        part.coalesce(1).write.mode("append").parquet(folder)
        s = keyed.account_state(J.stream(spark, folder, df.schema, 1), late="1 day", salts=3)
        schema = s.schema
        J.drain(s, J.append_to(out), mode="update", state=state)
    assert totals(J.latest(J.read_back(spark, out, schema), ["account_ref", "salt", "epoch"])) == by_hand(rows)


def test_freshness_forgets_users_whose_families_are_all_stale(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 9) if k % 5 else 99, rng.choice(["view", "click", "purchase", "scroll"]), T0 + dt.timedelta(hours=(k * 7) % 700 if k % 5 else k % 40)) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    kinds = {"health": "view", "contact": "click", "payment": "purchase"}
    want = {}
    for _, user, kind, ts in rows:
        for family, k in kinds.items():
            if kind == k:
                want[user, family] = max(want.get((user, family), ts), ts)
    for files, ttl in [(1, 24 * 7), (5, 24)]:
        state = scratch_path(spark, "state")
        s = keyed.freshness(J.stream(spark, J.land_in_order(df, "fresh", "ts", files), df.schema, 1), kinds, late="1 hour", ttl_hours=ttl, salts=2)
        seen = keyed.last_seen(J.updates(s, ["user_id", "salt", "epoch"], "fresh", state), list(kinds)).collect()
        assert {(r["user_id"], f): r[f] for r in seen for f in kinds if r[f] is not None} == want
        if files > 1:
            store = spark.read.format("statestore").option("path", state).option("stateVarName", "fold").load()
            assert 99 not in {r[0] for r in store.select("key.user_id").collect()}


def test_cells_of_a_restarted_stream(spark):
    from dunlin.operators import diagnosis
    rng = random.Random(2)
    rows = [(k, f"ISS_{rng.randint(0, 2)}", rng.choice(["card", "upi"]), T0 + dt.timedelta(minutes=rng.randint(0, 3000)), rng.random() < 0.7) for k in range(500)]
    df = spark.createDataFrame(rows, "event_id long, issuer_ref string, rail string, at_ts timestamp, succeeded boolean")
    folder, state, out = scratch_path(spark, "in"), scratch_path(spark, "state"), scratch_path(spark, "out")
    scored = None
    for part in (df.where("event_id < 200"), df.where("event_id >= 200")):
        part.coalesce(1).write.mode("append").parquet(folder)
        scored = J.online_cells(J.stream(spark, folder, df.schema, 1), out, state)
    again = J.online_cells(J.stream(spark, folder, df.schema, 1), out, state)      # nothing new: the last version stands
    want = sorted(map(str, diagnosis.baselines(diagnosis.cohort_cells(df)).select("level", "key", "bucket", "attempts", "declines").collect()))
    for got in (scored, again):
        assert sorted(map(str, got().select("level", "key", "bucket", "attempts", "declines").collect())) == want
