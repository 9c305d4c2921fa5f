"""Candidates are exchanged once for their propensities and not sorted; claims meet their subjects before they become rows per action."""

import math

from pyspark.sql import functions as F

from dunlin.operators import allocation as L


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _candidates(spark):
    n = F.col("id")
    return spark.range(3000).select(F.concat(F.lit("s"), (n % 300).cast("string")).alias("subject_token"), n.alias("ord"), ((n * 7919) % 1000).cast("double").alias("value"),
                                    *[F.lit(0).cast("long").alias(c) for c in L.dims.COST_COLUMNS], F.lit("sms").alias("action"), n.cast("string").alias("claim_id"))


def test_propensities_hash_the_small_side(spark):
    c = _candidates(spark)
    d = L.propensities(c, {})
    assert "SortMergeJoin" not in _plan(d) and _plan(d).count("ShuffledHashJoin") >= 2
    got = {r["ord"]: r["p"] for r in d.collect()}
    by = {}
    for r in c.collect():
        by.setdefault(r["subject_token"], []).append((r["ord"], r["value"]))
    for rows in by.values():
        hi, lo = max(v for _, v in rows), min(v for _, v in rows)
        w = {o: math.exp((v - hi) / (0.05 * (hi - lo))) for o, v in rows}
        for o, _ in rows:
            assert abs(got[o] - (0.95 * w[o] / sum(w.values()) + 0.05 / len(rows))) < 1e-12


def test_best_keeps_only_what_is_named(spark):
    b = L.best_per_subject(_candidates(spark), {}, ["claim_id"])
    assert b.columns == ["subject_token", "claim_id", "adjusted"]
    best = {}
    for r in _candidates(spark).collect():
        best.setdefault(r["subject_token"], []).append((-r["value"], r["ord"], r["claim_id"]))
    assert {r["subject_token"]: r["claim_id"] for r in b.collect()} == {s: min(x)[2] for s, x in best.items()}


def test_claims_without_eligible_action_and_control_arms(spark):
    e = spark.createDataFrame([("c1", 1, "s1", ["sms", "do_nothing"]), ("c2", 2, "s1", ["do_nothing"]), ("c3", 3, "s2", []), ("c4", 4, "s3", ["sms"])], "claim_id string, claim_no long, subject_token string, actions array<string>")
    e = e.select("*", F.lit(1000).cast("long").alias("amount_paise"), F.lit(9000).cast("long").alias("ltv_remaining_paise"))
    claims = e.select("claim_id", "subject_token").unionByName(spark.createDataFrame([("c9", "s2")], "claim_id string, subject_token string"))     # no facts at all
    people = spark.createDataFrame([("s1", "priced", 0), ("s2", "priced", 0), ("s3", L.dims.CONTROL_ARMS[0], 0)], "subject_token string, arm string, contacts_7d long")
    cand, drops = L.build_candidates(e, claims, people, F.lit(0.1))
    assert sorted((r["subject_token"], r["claim_id"] or "", r["action"], r["ord"] == L.NOTHING_ORD) for r in cand.collect()) == [
        ("s1", "", "do_nothing", True), ("s1", "c1", "sms", False), ("s2", "", "do_nothing", True)]
    assert sorted((r["subject_token"], r["claim_id"] or "", r["reason"]) for r in drops.collect()) == [
        ("s1", "c2", "gate_ineligible"), ("s2", "", "no_eligible_action"), ("s2", "c3", "gate_ineligible"), ("s2", "c9", "gate_ineligible"), ("s3", "", "control_arm")]
