"""Each wake of a scheduled action is judged on what holds at its own moment."""

import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import SF
from dunlin import dims
from dunlin.operators import rules as R
from dunlin.plans import q_streaming as QS
from dunlin.session import materialise
from dunlin.sources import bridge as B

T0 = dt.datetime(2024, 1, 20)


def test_context_as_of_equals_the_whole_history(spark):
    rng = random.Random(4)
    con = [(rng.choice([1, 2, 2, 2]), T0 + dt.timedelta(minutes=rng.randint(-40000, 3000)), rng.choice([*dims.CONTACT_CHANNELS[:4], "push"]), rng.choice(["connected", "sent", "replied", None])) for _ in range(3000)]
    ret = [(rng.choice([1, 2]), T0 + dt.timedelta(minutes=rng.randint(-50000, 3000))) for _ in range(1500)]
    mom = [(rng.choice([1, 2, 3]), T0 + dt.timedelta(minutes=rng.randint(-3000, 3000)), f"r{i}") for i in range(60)] + [(2, con[0][1], "tie")]
    got = {r["row_id"]: r for r in R.context_as_of(spark.createDataFrame(mom, "cust long, at timestamp, row_id string"), spark.createDataFrame(con, "cust long, at_ts timestamp, channel string, outcome string"),
                                                   spark.createDataFrame(ret, "cust long, at_ts timestamp"), "cust", split=320).collect()}
    assert len(got) == len(mom)
    whole = lambda rows, c, at: sorted((x for x in rows if x[0] == c and x[1] < at), key=lambda x: x[1], reverse=True)
    for c, at, rid in mom:
        r = got[rid]
        have = sorted(((x["at_ts"], x["channel"], x["outcome"]) for x in r["contacts"]), reverse=True, key=lambda x: x[0])
        every = whole(con, c, at)
        touches = [x[1] for x in every if x[2] in dims.CONTACT_CHANNELS]
        for hours, n in ((24, 1), (168, 3), (720, 8)):
            lo = at - dt.timedelta(hours=hours)
            mine = [x[0] for x in have if x[1] in dims.CONTACT_CHANNELS and x[0] >= lo]
            want = [t for t in touches if t >= lo]
            assert (len(mine) >= n) == (len(want) >= n) and mine[:n] == want[:n]
        for channel in ("voice", "sms", "whatsapp", "email"):
            assert max((x[0] for x in have if x[1] == channel), default=None) == max((x[1] for x in every if x[2] == channel), default=None)
        spoke = [x[1] for x in every if x[2] == "voice" and x[3] in ("connected", "replied")]
        assert max((x[0] for x in have if x[1] == "voice" and x[2] in ("connected", "replied")), default=None) == max(spoke, default=None)
        assert sorted(r["retries"], reverse=True)[:15] == [x[1] for x in whole(ret, c, at)][:15]


def test_a_contact_between_two_wakes_changes_the_outcome(spark):
    facts, due = materialise(B.gate_facts(spark, SF), "facts"), QS.due_now(spark, SF)
    contacts, retries = B.contacts(spark, SF).select("cust", "at_ts", "channel", "outcome"), B.retries(spark, SF).select("cust", "at_ts")
    plain = materialise(R.scheduled_actions(facts, due, contacts, retries, "cust", hops=1), "plain")
    first = materialise(R.wake(facts, due, contacts, retries, "cust", 0), "first")
    voice = first.where("outcome = 'DEFER' and action like 'voice%'").join(plain.where("outcome = 'ENQUEUED' and hops = 1").select("claim_id"), "claim_id").join(facts.select("claim_id", "cust"), "claim_id")
    one = voice.orderBy("claim_id").first()
    assert one is not None
    planted = spark.createDataFrame([(one["cust"], one["defer_until"] - dt.timedelta(minutes=1), "voice", "connected")], contacts.schema)
    again = R.scheduled_actions(facts, due.where(F.col("claim_id") == one["claim_id"]), contacts.unionByName(planted), retries, "cust", hops=1).first()
    assert (again["outcome"], again["requeued"], again["hops"]) == ("REQUEUED", True, 1)        # deferred again, and no hop is left
    at_the_moment = planted.withColumn("at_ts", F.lit(one["defer_until"]))
    same = R.scheduled_actions(facts, due.where(F.col("claim_id") == one["claim_id"]), contacts.unionByName(at_the_moment), retries, "cust", hops=1).first()
    assert same["outcome"] == "ENQUEUED"
