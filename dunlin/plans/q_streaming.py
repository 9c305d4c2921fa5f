"""Streaming queries: each drains a stream over the given tables and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.operators import rules as R
from dunlin.operators import state as S
from dunlin.plans import q_diagnosis as QD
from dunlin.plans import q_rules as Q
from dunlin.plans import q_state as QS
from dunlin.plans.q_functions import stale_families
from dunlin.plans.q_ingest import _FOLD, classified
from dunlin.plans.registry import query
from dunlin.plans.sqlbridge import AT
from dunlin.session import scratch_path, staged, table
from dunlin.sources import bridge as B
from dunlin.streaming import jobs as J
from dunlin.streaming import keyed

_PATHS: dict = {}


def landed(spark, d, name: str, build, order: str) -> tuple[str, object]:
    """Landing folder of a stream, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _PATHS:
        df = build()
        _PATHS[key] = (J.land(df, f"landing-{name}", order), df.schema)
    return _PATHS[key]


def deliveries_stream(spark, d) -> DataFrame:
    path, schema = landed(spark, d, "deliveries", lambda: B.deliveries(spark, d), "received_at")
    return J.stream(spark, path, schema)


def presentations_stream(spark, d) -> DataFrame:
    path, schema = landed(spark, d, "presentations", lambda: B.presentations(spark, d), "at_ts")
    return J.stream(spark, path, schema)


def accepted_stream(spark, d) -> DataFrame:
    """Accepted wire events, duplicates included."""
    def build():
        x = classified(spark, d).filter(F.col("verdict") == "accepted")
        return x.select("archive_id", "source", "received_at", "event.event_id", "event.event_ts", "event.account_ref", "event.succeeded")
    path, schema = landed(spark, d, "accepted", build, "received_at")
    return J.stream(spark, path, schema)


@query("r01_continuous_ingest", "select 'archive' as sink, count(*) as n from judged union all select 'events', count(*) from judged where pre = 'accepted' union all select 'quarantine', count(*) from judged where pre <> 'accepted'")
def r01(spark, d):
    out = scratch_path(spark, "ingest")
    J.continuous_ingest(deliveries_stream(spark, d), B.SECRETS, out)
    res = None
    for sink in ["archive", "events", "quarantine"]:
        x = spark.read.schema("archive_id long").parquet(f"{out}/{sink}").agg(F.count("archive_id").alias("n")).select(F.lit(sink).alias("sink"), "n")
        res = x if res is None else res.unionByName(x)
    return res


@query("r02_stream_dedupe", "select src as source, count(distinct eid) as n from judged where pre = 'accepted' group by 1")
def r02(spark, d):
    out = scratch_path(spark, "deduped")
    s = J.dedupe(accepted_stream(spark, d)).select("source", "event_id")
    J.drain(s, J.append_to(out))
    return J.read_back(spark, out, s.schema).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("r03_late_and_repeated", "select src as source, count(*) as archived, count(distinct eid) as effective from judged where pre = 'accepted' group by 1")
def r03(spark, d):
    """Redeliveries are archived twice and take effect once; arrival order changes neither."""
    out, s = scratch_path(spark, "late"), accepted_stream(spark, d)
    eff = J.dedupe(s).select("source", "event_id")
    J.drain(eff, J.append_to(out))
    e = J.read_back(spark, out, eff.schema).groupBy("source").agg(F.count(F.lit(1)).alias("effective"))
    a = J.updates(s.groupBy("source").agg(F.count(F.lit(1)).alias("archived")), ["source"], "late-counts")
    return a.join(e, "source").select("source", "archived", "effective")


@query("r04_account_state", f"with {_FOLD} select account_ref, eid as last_event, failed_attempts, events, resolved from fold")
def r04(spark, d):
    s = account_final(spark, d)
    return s.select("account_ref", F.col("last.event_id").alias("last_event"), "failed_attempts", "events", F.col("last.succeeded").alias("resolved"))


def account_final(spark, d) -> DataFrame:
    """Deduplicated events land in a folder; the account state is a stream over that folder."""
    out, ded = scratch_path(spark, "accounts-in"), J.dedupe(accepted_stream(spark, d))
    J.drain(ded, path=out)
    parts = J.updates(keyed.account_state(J.stream_by_size(spark, out, ded.schema)), ["account_ref", "salt", "epoch"], "accounts")
    return keyed.account_totals(parts)


@query("r05_decline_windows", same_as="a01_cohort_cells")
def r05(spark, d):
    w = J.decline_windows(presentations_stream(spark, d))
    return J.updates(w.drop("window"), ["level", "key", "bucket"], "windows").select("level", "key", "bucket", "attempts", "declines")


@query("r06_online_ewma", same_as="w05_z_score")
def r06(spark, d):
    scored = J.online_cells(presentations_stream(spark, d), scratch_path(spark, "cells"))()
    return scored.select("level", "key", "bucket", "attempts", F.round("rate", 6).alias("rate"), F.round("z", 5).alias("z"))


@query("r07_source_breaker", """with recursive e as (select source, epoch_us(at_ts) as t, succeeded, row_number() over (partition by source order by at_ts, event_id) as i from presentations),
    st as (select distinct source, 0::bigint as i, 0::bigint as fails, -1::bigint as opened, false as trip, 0::bigint as t from e
      union all select e.source, e.i, case when st.opened >= 0 and e.t - st.opened < 300000000 then fails when succeeded then 0 else fails + 1 end,
        case when st.opened >= 0 and e.t - st.opened < 300000000 then opened when succeeded then -1 when fails + 1 >= 3 and opened < 0 then e.t else opened end,
        not (st.opened >= 0 and e.t - st.opened < 300000000) and not succeeded and fails + 1 >= 3 and opened < 0, e.t
      from st join e on e.source = st.source and e.i = st.i + 1)
    select source, t as tripped_us from st where trip""")
def r07(spark, d):
    """Trips per source with a low threshold, so that the data contains some."""
    p = B.presentations(spark, d)
    return J.source_breaker(J.stream(spark, J.land_in_order(p, "landing-breaker", "at_ts", 8), p.schema, 4), scratch_path(spark, "trips"), threshold=3)


@query("r08_promise_tracker", "select p.claim_no, coalesce(min(epoch_us(q.paid_at)), -1) as paid_us from promises p left join payments q on q.claim_no = p.claim_no and q.paid_at >= p.made_at and q.paid_at <= p.due_at + interval 36 hour group by 1")
def r08(spark, d):
    """Every promise with its first payment by its own deadline, or -1: the outer join of two streams.

    The stream gives an unpaid promise once the watermark has passed its longest term; those it still
    holds when the input ends are the ones not yet written, and are still open."""
    p, ps = landed(spark, d, "promises", lambda: B.promises(spark, d).select("claim_no", "made_at", "due_at"), "made_at")
    q, qs = landed(spark, d, "payments", lambda: B.payments(spark, d).select("claim_no", "paid_at"), "paid_at")
    s = J.promise_tracker(J.stream(spark, p, ps, 4), J.stream(spark, q, qs, 4))
    out = scratch_path(spark, "tracked")
    J.drain(s, J.append_to(out))
    seen = J.read_back(spark, out, s.schema).groupBy("claim_no").agg(F.min("paid_at").alias("paid_at"))
    every = B.promises(spark, d).select("claim_no").distinct()
    return every.join(seen, "claim_no", "left").select("claim_no", F.coalesce(F.unix_micros("paid_at"), F.lit(-1)).alias("paid_us"))


@query("r09_cancel_on_stop", same_as="j14_earliest_stop")
def r09(spark, d):
    """Stop events as a stream against scheduled runs; the earliest stop of a run wins across batches."""
    path, schema = landed(spark, d, "stops", lambda: QS.stops(spark, d), "occurred_at")
    out = scratch_path(spark, "cancelled")
    subs = QS.subscriptions(QS.runs(spark, d))

    def each(batch: DataFrame, batch_id: int) -> None:
        ev = batch.withColumn("match_key", S.stop_key(F.col("name"), F.col("claim_id"), F.col("subject_token"), F.lit("default")))
        S.earliest_stop(subs, ev).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    J.drain(J.stream(spark, path, schema), each)
    hits = spark.read.schema("run_id long, name string, match_key string, occurred_at timestamp, event_seq long, batch int").parquet(out)
    g = hits.groupBy("run_id").agg(F.min_by(F.struct("name", "event_seq"), F.struct("occurred_at", "event_seq")).alias("h"))
    return g.select("run_id", "h.name", "h.event_seq")


def due_now(spark, d) -> DataFrame:
    return B.outbox(spark, d).select("claim_id", "action", B.at_lit().alias("due_at"))


def first_wake(spark, d) -> DataFrame:
    return staged(spark, d, "first-wake", lambda: R.wake(B.gate_facts(spark, d), due_now(spark, d), B.contacts(spark, d), B.retries(spark, d), "cust", 0))


@query("r10_scheduled_step", f"with {Q.GATE} select g.claim_id, case when full_rank = 0 then 'ENQUEUED' when full_rank = 1 then 'DEFER' else 'BLOCKED' end as outcome, coalesce(case when full_rank = 1 then epoch_us(wait) end, -1) as next_us from gdec g join outbox o on o.claim_id = g.claim_id and o.action = g.action")
def r10s(spark, d):
    return first_wake(spark, d).select("claim_id", "outcome", F.coalesce(F.unix_micros("defer_until"), F.lit(-1)).alias("next_us"))


def _hop_sql(h: int) -> str:
    """CTEs of one wake: the due rows, the facts as of each one's own moment, and the gate's answer."""
    source = (f"select o.claim_id, o.action, o.cust, {AT} as m from outbox o" if h == 0 else
              f"select g.claim_id, g.action, p.cust, g.wait as m from gdec_h{h - 1} g join hop{h - 1} p on p.claim_id = g.claim_id and p.action = g.action where g.full_rank = 1 and g.wait is not null")
    return f"""hop{h} as ({source}),
    cstat_h{h} as (select claim_id, max(t) filter (where rk = 1 and t >= m - interval 24 hour) as c24, max(t) filter (where rk = 3 and t >= m - interval 168 hour) as c168, max(t) filter (where rk = 8 and t >= m - interval 720 hour) as c720,
        max(t) as last_any, max(t) filter (where channel = 'voice') as last_voice, max(t) filter (where channel = 'voice' and outcome in ('connected', 'replied')) as last_voice_conn,
        max(t) filter (where channel = 'whatsapp') as last_whatsapp, max(t) filter (where channel = 'sms') as last_sms, max(t) filter (where channel = 'email') as last_email
      from (select h.claim_id, c.at_ts as t, channel, outcome, h.m, row_number() over (partition by h.claim_id order by c.at_ts desc) as rk from contacts c join hop{h} h on h.cust = c.cust where c.at_ts < h.m) group by 1),
    rstat_h{h} as (select claim_id, max(t) filter (where rk = 15) as r30, max(t) filter (where rk = 1 and t >= m - interval 1 day) as r1
      from (select h.claim_id, r.at_ts as t, h.m, row_number() over (partition by h.claim_id order by r.at_ts desc) as rk from retries r join hop{h} h on h.cust = r.cust where r.at_ts < h.m and r.at_ts >= h.m - interval 30 day) group by 1),
    gctx_h{h} as (select g.*, s.* exclude (cust, subject_token), k.* exclude (claim_id), t.* exclude (claim_id), h.m,
        timezone(s.tz_zone, h.m at time zone 'UTC') as loc, hour(timezone(s.tz_zone, h.m at time zone 'UTC')) * 60 + minute(timezone(s.tz_zone, h.m at time zone 'UTC')) as mi
      from gate_claims g join subjects s using (cust) join hop{h} h on h.claim_id = g.claim_id left join cstat_h{h} k on k.claim_id = g.claim_id left join rstat_h{h} t on t.claim_id = g.claim_id),
    {Q.gate_sql(f'_h{h}')},
    out_h{h} as (select g.claim_id, g.action, case when g.full_rank = 0 then 'ENQUEUED' when g.full_rank = 1 and g.wait is not null then '{"REQUEUED" if h == 3 else "DEFER"}' else 'BLOCKED' end as outcome, {h} as hops
      from gdec_h{h} g join hop{h} p on p.claim_id = g.claim_id and p.action = g.action)"""


@query("r10_scheduled_action", "with " + ", ".join(_hop_sql(h) for h in range(4)) +
       " select claim_id, action, outcome, outcome in ('BLOCKED', 'REQUEUED') as requeued, hops from (" + " union all ".join(f"select * from out_h{h}" for h in range(4)) + ") where outcome <> 'DEFER'")
def r10(spark, d):
    """Every scheduled action to its end, each wake judged on the contacts and retries before its own moment."""
    return R.scheduled_actions(B.gate_facts(spark, d), due_now(spark, d), B.contacts(spark, d), B.retries(spark, d), "cust")


@query("r12_freshness", same_as="d09_stale_families")
def r12(spark, d):
    kinds = dict(zip([f for f, _ in dims.FRESHNESS_TTL], ["view", "click", "purchase", "signup"]))
    path, schema = landed(spark, d, "events", lambda: table(spark, d, "events"), "ts")
    events = J.stream(spark, path, schema).filter(F.col("ts") < B.at_lit())
    fresh = keyed.last_seen(J.updates(keyed.freshness(events, kinds), ["user_id", "salt", "epoch"], "fresh"), list(kinds))
    return fresh.select("user_id", F.array_join(stale_families(B.at_lit()), ",").alias("stale"))
