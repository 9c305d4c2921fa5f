"""Batches of reservations against a plain loop over requests."""

import random

import pytest

from dunlin import dims
from dunlin.operators import allocation, reservations

COST = {a[0]: dict(zip(dims.BUDGETS, a[3:9])) for a in dims.ACTIONS}
REQ = "idempotency_key string, ord long, subject_token string, claim_id string, action string, tier string"
RES = "idempotency_key string, claim_id string, status string, budget string, amount long"


def loop(requests, held, caps):
    left = {b: max(c - sum(r[4] for r in held if r[3] == b and r[2] == "hard"), 0) for b, c in caps.items()}
    known, out = {r[0] for r in held}, {}
    for key, n, _, _, action, tier in sorted(requests, key=lambda r: r[1]):
        cost = {b: v for b, v in COST.get(action, {}).items() if v}
        if action not in COST:
            out[key, n] = "unknown_action"
        elif not cost:
            out[key, n] = "free"
        elif key in known:
            out[key, n] = "reused"
        elif tier == "soft":
            out[key, n] = "soft"
            known.add(key)
        elif any(b not in left for b in cost):
            out[key, n] = "undeclared"
        elif all(v <= left[b] for b, v in cost.items()):
            out[key, n] = "hard"
            known.add(key)
            left = {b: v - cost.get(b, 0) for b, v in left.items()}
        else:
            out[key, n] = "refused"
    return out


@pytest.mark.parametrize("caps", [{"contact": 25, "voice": 5, "rupee": 9_000, "retry": 0, "human": 300}])
def test_a_batch_equals_the_loop_and_takes_nothing_twice(spark, caps):
    rng = random.Random(3)
    names = [*dims.ACTION_NAMES, "nobody_listed_this"]
    by_key = {f"k{i}": (f"sub_{rng.randrange(1 << 32):08x}", f"c{i}", rng.choice(names), rng.choice(["hard", "hard", "soft"])) for i in range(180)}
    keys = [*by_key, *rng.sample(list(by_key), 40)]
    rng.shuffle(keys)
    requests = [(k, n, *by_key[k]) for n, k in enumerate(keys)]
    held = [(k, by_key[k][1], status, b, v) for k, status in (("k3", "hard"), ("k5", "soft"), ("k8", "released")) for b, v in COST["voice_call"].items() if v]
    asked, now = spark.createDataFrame(requests, REQ), spark.createDataFrame(held, RES)
    limits = spark.createDataFrame(list(caps.items()), "budget string, cap long")
    got, after = reservations.reserve(asked, now, limits)
    want = loop(requests, held, caps)
    assert {(r["idempotency_key"], r["ord"]): r["outcome"] for r in got.collect()} == want
    assert {"hard", "soft", "refused", "reused", "free", "unknown_action"} <= set(want.values())
    rows = sorted(map(tuple, after.collect()))
    for b, cap in caps.items():
        assert sum(r[4] for r in rows if r[3] == b and r[2] == "hard") <= cap
    again, same = reservations.reserve(asked, after, limits)
    assert {r["outcome"] for r in again.collect()} <= {"reused", "free", "unknown_action", "refused", "undeclared"}
    assert sorted(map(tuple, same.collect())) == rows


def test_empty_batch_and_no_caps(spark):
    none = spark.createDataFrame([], REQ)
    held, caps = spark.createDataFrame([], RES), spark.createDataFrame([("contact", None)], "budget string, cap long")
    assert reservations.reserve(none, held, caps)[0].collect() == []
    one = spark.createDataFrame([("k", 1, "sub_0", "c", "sms", "hard")], REQ)
    assert [r["outcome"] for r in reservations.reserve(one, held, caps)[0].collect()] == ["undeclared"]


def test_overruns_in_one_chunk_and_across_chunks(spark):
    rng = random.Random(8)
    rows = [(f"sub_{n:08x}", float(-n), rng.choice(dims.ACTION_NAMES)) for n in range(400)]
    table = spark.createDataFrame(rows, "subject_token string, adjusted double, action string").join(
        dims.action_dim(spark).select("action", *dims.COST_COLUMNS), "action")
    caps = {"contact": 90, "voice": 40, "rupee": 30_000, "retry": 30}
    left, want = dict(caps), {}
    for token, _, action in rows:
        cost = {b: v for b, v in COST[action].items() if b in caps}
        want[token] = all(v <= left[b] for b, v in cost.items())
        if want[token]:
            left = {b: left[b] - cost[b] for b in left}
    for chunk in (45, 1000):
        got = allocation.admit(table, caps, chunk=chunk)
        assert {r["subject_token"]: r["admitted"] for r in got.collect()} == want
