"""Distributed operators against brute force on small fixtures."""

import random

import pytest

import numpy as np
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.operators import allocation as L
from dunlin.operators import ingest, scale
from dunlin.operators import measurement as M
from dunlin.operators import rules as R
from dunlin.sources import bridge as B
from dunlin.sources import ruleset
from dunlin.streaming import jobs as J


def test_running_with_a_hot_value(spark):
    """A third of the rows share one value: ranks stay exact and the value is split into several buckets."""
    rng = random.Random(1)
    rows = [(i, 7.0 if i % 3 == 0 else float(rng.randrange(50))) for i in range(900)]
    df = spark.createDataFrame(rows, ["id", "v"])
    b = scale.value_bucket(df, "v", "id", descending=True)
    got = {r["id"]: r["place"] for r in scale.running(df, [], b, [F.col("v").desc(), F.col("id")], rank="place").collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    assert got == want
    assert df.filter("v = 7.0").select(b.alias("b")).distinct().count() > 5


def test_exact_quantile(spark):
    vals = [random.Random(2).randrange(1000) for _ in range(501)]
    df = spark.createDataFrame([(1, v) for v in vals], ["k", "v"])
    for q in (0.0, 0.3, 0.5, 0.975, 1.0):
        assert abs(scale.exact_quantile(df, ["k"], "v", q, "x").first()["x"] - np.percentile(vals, q * 100)) < 1e-9


def test_run_length(spark):
    rng = random.Random(3)
    rows = [("s", i, rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(rows, ["k", "i", "ok"])
    got = {r["i"]: r["n"] for r in scale.run_length(df, ["k"], F.floor(F.col("i") / 37), [F.col("i")], ~F.col("ok"), F.col("ok"), "n").collect()}
    n = 0
    for _, i, ok in rows:
        n = 0 if ok else n + 1
        assert got[i] == n


def test_breaker_skips_the_rest_of_the_batch(spark):
    rows = [(i, "pgw", b"x", "t=1,v1=" + "0" * 64) for i in range(30)]
    df = spark.createDataFrame(rows, "archive_id long, source string, raw binary, signature string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    v = {r["archive_id"]: r["verdict"] for r in ingest.admit(df, B.SECRETS).collect()}
    assert all(v[i] == "signature_invalid" for i in range(20)) and all(v[i] == "tripped" for i in range(20, 30))


def test_decile_cutoffs(spark):
    for n in (3, 10, 57):
        vals = sorted(random.Random(n).randrange(100) for _ in range(n))
        df = spark.createDataFrame([(v,) for v in vals], "total_paise long")
        assert ingest.decile_cutoffs(df) == [vals[min(n - 1, i * n // 10)] for i in range(1, 10)]


# ---- prices -------------------------------------------------------------------------------------------
def planted(n, seed):
    rng = np.random.default_rng(seed)
    cost = {a[0]: np.array(a[3:9], dtype=float) for a in dims.ACTIONS}
    rows = []
    for s in range(n):
        tok = f"sub_{s:032x}"
        for i, a in enumerate(rng.choice([x for x in dims.ACTION_NAMES if x != "do_nothing"], 6, replace=False)):
            rows.append((tok, f"c{s}", str(a), float(rng.normal(4000, 6000)), *map(int, cost[str(a)]), 0.1, bool(cost[str(a)][0] == 0), i))
        rows.append((tok, None, "do_nothing", 0.0, 0, 0, 0, 0, 0, 0, 0.0, True, L.NOTHING_ORD))
    return rows


SCHEMA = ("subject_token string, claim_id string, action string, value double, contact long, voice_minutes long, rupee_paise long, retry_attempts long, "
          "human_minutes long, concession_paise long, uplift double, is_silent boolean, ord long")


def bisection(rows, dim, cap, prices):
    """The plain 28-step halving on one dimension."""
    k = dims.BUDGETS.index(dim)
    tokens = sorted({r[0] for r in rows})
    groups = [[r for r in rows if r[0] == t] for t in tokens]

    def used(lam):
        p = np.array([prices.get(b, 0.0) for b in dims.BUDGETS])
        p[k] = lam
        total = 0
        for g in groups:
            adj = [r[3] - float(np.dot(p, r[4:10])) for r in g]
            j = int(np.argmax(adj))
            if adj[j] > 0:
                total += g[j][4 + k]
        return total
    if used(0.0) <= cap:
        return 0.0
    lo, hi = 0.0, L.LAMBDA_MAX
    for _ in range(L.STEPS):
        mid = (lo + hi) / 2
        if used(mid) > cap:
            lo = mid
        else:
            hi = mid
    return hi


def test_price_equals_bisection(spark):
    rows = planted(40, 5)
    t = L.compact(spark.createDataFrame(rows, SCHEMA))
    for dim, cap, others in [("contact", 8, {}), ("rupee", 900, {"contact": 1500.0}), ("voice", 6, {"rupee": 3.0}), ("retry", 50, {})]:
        assert abs(L.price_of(t, dim, cap, others) - bisection(rows, dim, cap, others)) < 1e-6, dim


def test_a_plan_over_its_caps_is_an_error(spark):
    with pytest.raises(ValueError, match="no plan within the caps"):
        L.solve(spark.createDataFrame(planted(20, 6), SCHEMA), {"contact": -1}, max_shrink=1)


def test_solution_respects_caps_and_slack(spark):
    c = spark.createDataFrame(planted(60, 6), SCHEMA)
    caps = {"contact": 15, "voice": 5, "rupee": 3600, "retry": 200}
    prices, active, _ = L.solve(c, caps)
    used = L.spend(L.compact(active), prices)
    assert all(used[b] <= v for b, v in caps.items())
    assert all(p >= 0 for p in prices.values()) and prices["retry"] == 0.0 and prices["human"] == 0.0


def test_prices_after_a_shrink_are_those_of_what_is_left(spark):
    """Two coupled budgets that no price fits at once: the search starts from zero for those who stay."""
    c = spark.createDataFrame(planted(60, 11), SCHEMA)
    for caps in ({"contact": 3, "voice": 1, "rupee": 200}, {"contact": 9, "voice": 2}):
        prices, active, dropped = L.solve(c, caps)
        again = L.solve(active, caps)
        assert again[0] == prices and again[2] is None
        assert dropped is None or active.count() + dropped.count() == c.count()


def test_admission_equals_plain_greedy(spark):
    rng = random.Random(9)
    cost = {a[0]: dict(zip(dims.COST_COLUMNS, a[3:9])) for a in dims.ACTIONS}
    rows = [(f"sub_{i:032x}", f"c{i}", rng.choice(dims.ACTION_NAMES), float(rng.randrange(40))) for i in range(300)]
    df = spark.createDataFrame([(t, c, a, v, *[int(cost[a][x]) for x in dims.COST_COLUMNS]) for t, c, a, v in rows],
                               "subject_token string, claim_id string, action string, adjusted double, " + ", ".join(f"{c} long" for c in dims.COST_COLUMNS))
    caps = {"contact": 60, "voice": 40, "rupee": 20000, "retry": 30}
    left, want = dict(caps), {}
    names = dict(zip(dims.BUDGETS, dims.COST_COLUMNS))
    for t, c, a, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        ok = all(cost[a][names[b]] <= left[b] for b in caps)
        want[t] = (ok, left["contact"])
        if ok:
            for b in caps:
                left[b] -= cost[a][names[b]]
    got = {r["subject_token"]: (r["admitted"], r["room_contact"]) for r in L.admit(df, caps, chunk=50).collect()}
    assert got == want


def test_propensities(spark):
    d = L.propensities(spark.createDataFrame(planted(20, 7), SCHEMA), {"contact": 1000.0})
    g = d.groupBy("subject_token").agg(F.sum("p").alias("s"), F.min("p").alias("lo"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["lo"] >= 0.05 / r["n"] - 1e-12 for r in g)


# ---- rules ------------------------------------------------------------------------------------------
def permissive(spark, **over):
    at = F.lit("2026-03-17 06:30:00").cast("timestamp")
    flags = ["forborne", "minor", "erasure_requested", "hardship", "complaint_open", "disputed", "ptp_active", "payment_pending", "issuer_degraded"]
    cols = {
        "claim_id": F.lit("c1"), "subject_token": F.lit("s1"), "target": F.lit("obligor"), "tz_zone": F.lit("Asia/Kolkata"), "amount_paise": F.lit(129900),
        "mandate_cap_paise": F.lit(500000), "predebit_notice_at": F.lit("2026-03-15 06:30:00").cast("timestamp"), "decline_category": F.lit("soft"), "advice_code": F.lit(None).cast("string"),
        "consent": F.map_from_arrays(F.array(*map(F.lit, dims.CONTACT_CHANNELS)), F.array_repeat(F.lit("granted"), 8)), "opted_out": F.array().cast("array<string>"),
        "quiet_start_min": F.lit(None).cast("int"), "quiet_end_min": F.lit(None).cast("int"), "bank_holidays": F.array().cast("array<date>"),
        "contacts": F.array().cast("array<struct<at_ts:timestamp,channel:string,outcome:string>>"), "retries": F.array().cast("array<timestamp>"),
        "certificate_valid_until": F.lit(None).cast("timestamp"),
        "flags": F.struct(*[F.lit(False).alias(f) for f in flags], F.lit(True).alias("identity_verified"), *[F.lit(None).cast("timestamp").alias(f) for f in ("ptp_freeze_until", "payment_pending_until", "issuer_degraded_until")]),
    }
    cols.update(over)
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]), at


def decisions(spark, moment=None, **over):
    ctx, at = permissive(spark, **over)
    at = F.lit(moment).cast("timestamp") if moment else at
    return {r["action"]: r for r in R.evaluate(ctx, at).collect()}


def test_permissive_context_allows_everything(spark):
    assert all(r["decision"] == "allow" for r in decisions(spark).values())


def test_nineteen_oh_one_call_defers_to_morning(spark):
    d = decisions(spark, "2026-03-17 13:31:00")
    assert d["voice_call"]["decision"] == "defer" and str(d["voice_call"]["defer_until"]) == "2026-03-18 02:30:00"
    assert d["retry"]["decision"] == "allow" and d["statutory_notice"]["decision"] == "allow"


def test_sixteenth_retry_blocks_and_exact_window_edge(spark):
    def tries(n, first):
        return F.array(*[F.expr(f"timestamp '{first}' + interval {i} minutes") for i in range(n)])
    d = decisions(spark, retries=tries(15, "2026-03-01 00:00:00"))
    assert d["retry"]["decision"] == "block" and list(d["retry"]["blocking"]) == ["NET-RETRY-30D"] and d["card_updater"]["decision"] == "allow"
    assert decisions(spark, retries=tries(14, "2026-03-01 00:00:00"))["retry"]["decision"] == "allow"
    # exactly thirty days old still counts; a second older does not
    edge = F.array(*[F.lit("2026-02-15 06:30:00").cast("timestamp")] * 15)
    assert decisions(spark, retries=edge)["retry"]["decision"] == "block"
    old = F.array(*[F.lit("2026-02-15 06:29:59").cast("timestamp")] * 15)
    assert decisions(spark, retries=old)["retry"]["decision"] == "allow"


def test_missing_facts_fail_closed(spark):
    d = decisions(spark, tz_zone=F.lit(None).cast("string"), mandate_cap_paise=F.lit(None).cast("long"), target=F.lit(None).cast("string"))
    assert d["sms"]["decision"] == "block_permanent" and d["retry"]["decision"] == "block"


def test_rule_mix():
    rules = ruleset.load()
    assert len(rules) == 33
    count = lambda f: {k: sum(1 for r in rules if f(r) == k) for k in {f(r) for r in rules}}
    assert count(lambda r: r.basis) == {"statutory": 8, "network_rule": 4, "policy_choice": 21}
    assert count(lambda r: r.status) == {"in_force": 30, "draft": 1, "advisory": 1, "contested": 1}


def test_bounded_contacts_keep_every_answer(spark):
    """A subject with thousands of contacts: the bounded array gives the same verdicts as the whole history."""
    rng = random.Random(4)
    at = F.lit("2026-03-17 06:30:00").cast("timestamp")
    rows = [(1, rng.randrange(0, 40 * 86400), rng.choice(dims.CONTACT_CHANNELS), rng.choice(["connected", "no_answer", "delivered"])) for _ in range(3000)]
    df = spark.createDataFrame(rows, ["cust", "ago", "channel", "outcome"]).withColumn("at_ts", F.timestamp_seconds(F.unix_seconds(at) - F.col("ago")))
    small = R.recent_contacts(df, "cust", at).first()["contacts"]
    full = df.groupBy("cust").agg(F.collect_list(F.struct("at_ts", "channel", "outcome")).alias("contacts"))
    small_df = R.recent_contacts(df, "cust", at)
    assert len(small) < 3000

    def run(c):
        ctx, _ = permissive(spark)
        ctx = ctx.drop("contacts").withColumn("cust", F.lit(1).cast("long")).join(c, "cust")
        return {r["action"]: (r["decision"], r["defer_until"], list(r["blocking"])) for r in R.evaluate(ctx, at).collect()}
    assert run(small_df) == run(full)


# ---- measurement, streams ------------------------------------------------------------------------------
def test_poisson_weights_have_unit_mean(spark):
    m = spark.range(65536).agg(F.avg(M.poisson_weight(F.col("id"))).alias("m")).first()["m"]
    assert abs(m - 1.0) < 1e-3


def test_ntile_sizes(spark):
    for n in (7, 10, 23, 100):
        got = spark.range(1, n + 1).select(M.ntile_of(F.col("id"), F.lit(n)).alias("t")).groupBy("t").count().orderBy("t").collect()
        want = [len(x) for x in np.array_split(np.arange(n), 10) if len(x)]
        assert [r["count"] for r in got] == want


def breaker_by_hand(rows, threshold, cooldown_us):
    fails, opened, out = 0, None, []
    for at, ok in rows:
        if opened is not None and at - opened < cooldown_us:
            continue
        if ok:
            fails, opened = 0, None
            continue
        fails += 1
        if fails >= threshold and opened is None:
            opened = at
            out.append(at)
    return out


def test_stream_breaker_in_any_micro_batch_split(spark):
    rng = random.Random(8)
    rows = [(i, i * 40, rng.random() < 0.35) for i in range(400)]
    df = spark.createDataFrame(rows, ["event_id", "sec", "succeeded"]).select("event_id", F.lit("pgw").alias("source"), F.timestamp_seconds("sec").alias("at_ts"), "succeeded")
    want = breaker_by_hand([(s * 1000000, ok) for _, s, ok in rows], 3, 300 * 1000000)
    for files, per in ((6, 1), (2, 2)):
        from dunlin.session import scratch_path
        s = J.source_breaker(J.stream(spark, J.land_in_order(df, "b", "at_ts", files), df.schema, per), scratch_path(spark, "t"), threshold=3)
        assert sorted(r["tripped_us"] for r in s.collect()) == want
