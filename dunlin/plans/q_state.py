"""State, ledger, queue and breaker queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, times
from dunlin.operators import measurement as M
from dunlin.operators import reservations as R
from dunlin.operators import scale
from dunlin.operators import state as S
from dunlin.plans.registry import query
from dunlin.plans.sqlbridge import AT, CTES, pick
from dunlin.session import staged, table
from dunlin.sources import bridge as B

# ---- transitions ----------------------------------------------------------------------------------
CTES["moves"] = f"""select case when claim_no % 97 = 0 then 'clm-missing-' || claim_no else claim_id end as claim_id,
      case when claim_no % 5 = 0 then 'detected' else state end as expected, {pick(dims.CLAIM_STATES, 'claim_no % 13')} as dest from claims"""


def moves(spark, d) -> DataFrame:
    n = F.col("claim_no")
    return B.claims(spark, d).select(
        F.when(n % 97 == 0, F.concat(F.lit("clm-missing-"), n.cast("string"))).otherwise(F.col("claim_id")).alias("claim_id"),
        F.when(n % 5 == 0, "detected").otherwise(F.col("state")).alias("expected"), F.get(F.array(*map(F.lit, dims.CLAIM_STATES)), (n % 13).cast("int")).alias("dest"))


@query("f10_legal_transition", "select m.claim_id, e.frm is not null as legal, m.expected in ('forborne', 'written_off') as absorbing from moves m left join state_edges e on e.frm = m.expected and e.dest = m.dest")
def f10(spark, d):
    return moves(spark, d).select("claim_id", S.legal_move(F.col("expected"), F.col("dest")).alias("legal"), F.col("expected").isin(*dims.ABSORBING_STATES).alias("absorbing"))


_TR = """tr as (select m.*, c.state, case when e.frm is null then 'illegal' when c.claim_id is null then 'not_found' when c.state <> m.expected then 'concurrent' else 'applied' end as outcome
      from moves m left join state_edges e on e.frm = m.expected and e.dest = m.dest left join claims c on c.claim_id = m.claim_id)"""


@query("j22_conditional_update", f"with {_TR} select claim_id, outcome, coalesce(case when outcome = 'applied' then dest else state end, '') as after from tr")
def j22(spark, d):
    return S.apply_transitions(B.claims(spark, d), moves(spark, d)).select("claim_id", "outcome", F.coalesce("after", F.lit("")).alias("after"))


# ---- queue ---------------------------------------------------------------------------------------------
@query("t01_ready_queue", f"select claim_id, priority, epoch_us(not_before) as not_before_us from outbox where status = 'pending' and not_before <= {AT} order by priority desc, not_before, claim_id limit 500")
def t01(spark, d):
    return S.ready(B.outbox(spark, d), B.at_lit(), 500).select("claim_id", "priority", F.unix_micros("not_before").alias("not_before_us"))


@query("a18_queue_counts", "select status, count(*) as n from outbox group by 1")
def a18(spark, d):
    return B.outbox(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("p17_idempotency_key", "select claim_id, sha256(claim_id || ':' || action || ':cycle-1:cert-' || claim_no) as key from outbox")
def p17(spark, d):
    o = B.outbox(spark, d)
    return o.select("claim_id", S.idempotency_key(F.col("claim_id"), F.col("action"), F.lit("cycle-1"), F.concat(F.lit("cert-"), F.col("claim_no").cast("string"))).alias("key"))


_DISP = f"""disp as (select o.*, case when not ({AT} >= cert_valid_from and {AT} <= cert_valid_until) then 'cert_expired' when claim_no % 29 = 0 then 'terminal_state' when channel not in ('silent', 'whatsapp', 'sms', 'email', 'voice', 'payment_link') then 'dead'
      when claim_no % 23 = 0 then 'dead' when claim_no % 3 = 0 and attempts >= 6 then 'dead' when claim_no % 3 = 0 then 'rescheduled' else 'sent' end as outcome from outbox o join action_dim using (action) where status = 'pending' and not_before <= {AT})"""


@query("r13_dispatch_outcome", f"with {_DISP} select claim_id, outcome, case when outcome = 'rescheduled' then least(cast(2 ** greatest(attempts, 1) as bigint), 900) else 0 end as wait_s from disp")
def r13(spark, d):
    due = B.outbox(spark, d).filter((F.col("status") == "pending") & (F.col("not_before") <= B.at_lit()))
    n = F.col("claim_no")
    due = due.withColumn("state", F.when(n % 29 == 0, "written_off").otherwise(F.col("state")))
    chan = dims.lookup(F.col("action"), dims.CHANNEL_OF)
    out = S.dispatch_outcome(B.at_lit(), ["silent", "whatsapp", "sms", "email", "voice", "payment_link"], chan, n % 3 == 0, n % 23 == 0)
    return due.select("claim_id", out.alias("outcome"), "attempts").select("claim_id", "outcome", F.when(F.col("outcome") == "rescheduled", times.backoff_seconds(F.col("attempts"))).otherwise(F.lit(0)).cast("long").alias("wait_s"))


@query("r14_freeze_resume", "select case when status in ('pending', 'failed') then 'cancelled' else status end as status, count(*) as n, count(*) filter (where status in ('pending', 'failed')) as held from outbox group by 1")
def r14(spark, d):
    o = B.outbox(spark, d)
    nxt, held = S.freeze(o, B.at_lit())
    n = nxt.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    h = held.agg(F.count(F.lit(1)).alias("held")).withColumn("status", F.lit("cancelled"))
    return n.join(h, "status", "left").na.fill(0)


@query("j17_held_yet_sent", "select count(*) filter (where status in ('pending', 'failed')) as held, 0 as sent from outbox")
def j17(spark, d):
    nxt, held = S.freeze(B.outbox(spark, d), B.at_lit())
    sent = nxt.filter(F.col("status").isin("sent", "in_flight")).select("idempotency_key")
    bad = held.join(sent, "idempotency_key", "left_semi").agg(F.lit(0).cast("long").alias("held"), F.count(F.lit(1)).alias("sent"))
    return held.agg(F.count(F.lit(1)).alias("held"), F.lit(0).cast("long").alias("sent")).unionByName(bad).agg(F.sum("held").alias("held"), F.sum("sent").cast("int").alias("sent"))


# ---- reservations ------------------------------------------------------------------------------------
CTES["reservations"] = f"""select idempotency_key, claim_id, claim_no, state, b.budget, b.amount, case claim_no % 5 when 0 then 'soft' when 1 then 'hard' when 2 then 'consumed' when 3 then 'hard' else 'released' end as status,
      {AT} + to_seconds(((claim_no % 31) - 15) * 600) as expires_at from outbox join action_dim using (action) cross join lateral (select 'contact' as budget, contact as amount union all select 'voice', voice_minutes union all select 'rupee', rupee_paise
      union all select 'retry', retry_attempts union all select 'human', human_minutes union all select 'concession', concession_paise) b where b.amount > 0"""


def reservations(spark, d) -> DataFrame:
    o = B.outbox(spark, d)
    j = o.join(F.broadcast(dims.action_dim(spark).drop("channel")), "action")
    n = F.col("claim_no")
    st = F.when(n % 5 == 0, "soft").when((n % 5 == 1) | (n % 5 == 3), "hard").when(n % 5 == 2, "consumed").otherwise("released")
    costs = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(c).alias("amount")) for b, c in zip(dims.BUDGETS, dims.COST_COLUMNS)])
    return j.select("idempotency_key", "claim_id", "claim_no", "state", st.alias("status"), times.add_seconds(B.at_lit(), ((n % 31) - 15) * 600.0).alias("expires_at"),
                    F.inline(F.filter(costs, lambda c: c["amount"] > 0)))


@query("a19_soft_demand", "select budget, cast(sum(amount) as bigint) as demand, count(*) as n from reservations where status = 'soft' group by 1")
def a19(spark, d):
    return reservations(spark, d).filter(F.col("status") == "soft").groupBy("budget").agg(F.sum("amount").alias("demand"), F.count(F.lit(1)).alias("n"))


_CAPS = """caps as (select budget, cast(sum(amount) as bigint) as cap from reservations group by 1)"""


@query("a21_remaining_budget", f"with {_CAPS}, h as (select budget, cast(sum(amount) as bigint) as held from reservations where status = 'hard' group by 1) select budget, cap, coalesce(held, 0) as held, cap - coalesce(held, 0) as remaining from caps left join h using (budget)")
def a21(spark, d):
    r = reservations(spark, d)
    caps = r.groupBy("budget").agg(F.sum("amount").alias("cap"))
    return S.remaining(r, caps)


@query("j26_release_finished", "select budget, count(*) filter (where status in ('soft', 'hard') and state = 'promised') as released, cast(coalesce(sum(amount) filter (where status = 'hard' and state = 'promised'), 0) as bigint) as credit from reservations group by 1")
def j26(spark, d):
    r = reservations(spark, d)
    done = B.claims(spark, d).filter(F.col("state") == "promised").select("claim_id")
    keys = r.join(done, "claim_id", "left_semi").select("idempotency_key")
    out = S.move_reservations(r.withColumnRenamed("status", "was").withColumn("status", F.col("was")), keys, "release")
    moved = (F.col("status") == "released") & F.col("was").isin("soft", "hard")
    return out.groupBy("budget").agg(F.count_if(moved).alias("released"), F.sum("credit").alias("credit"))


@query("m25_reservation_moves", """select budget, case when claim_no % 3 = 0 and status = 'hard' then 'consumed' when claim_no % 3 = 1 and status = 'soft' then 'hard' when claim_no % 3 = 2 and status in ('soft', 'hard') then 'released' else status end as status, count(*) as n,
      cast(sum(case when claim_no % 3 = 2 and status = 'hard' then amount else 0 end) as bigint) as credit from reservations group by 1, 2""")
def m25(spark, d):
    r, out = reservations(spark, d), None
    for i, op in enumerate(["consume", "harden", "release"]):
        part = r.filter(F.col("claim_no") % 3 == i)
        x = S.move_reservations(part, part.select("idempotency_key"), op)
        out = x if out is None else out.unionByName(x)
    return out.groupBy("budget", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("credit").alias("credit"))


@query("r11_expire_stale", f"select budget, count(*) filter (where status in ('soft', 'hard') and expires_at < {AT}) as expired, cast(coalesce(sum(amount) filter (where status = 'hard' and expires_at < {AT}), 0) as bigint) as credit from reservations group by 1")
def r11(spark, d):
    r = reservations(spark, d)
    stale = r.filter(F.col("expires_at") < B.at_lit()).select("idempotency_key")
    out = S.move_reservations(r, stale, "expire")
    return out.groupBy("budget").agg(F.count_if(F.col("status") == "expired").alias("expired"), F.sum("credit").alias("credit"))


# The next cycle asks for every queued action under a new key; some old keys are asked for again, and some new ones twice.
CTES["asked"] = f"""select claim_id, claim_no, action, case when epoch_us(not_before) - epoch_us({AT}) <= 900000000 then 'hard' else 'soft' end as tier, claim_no * 4 + n as ord,
      idempotency_key || case when n = 0 then '' else ':2' end as idempotency_key from outbox join (values (0), (1), (2)) v(n) on n = 1 or (n = 0 and claim_no % 4 = 0) or (n = 2 and claim_no % 9 = 1)"""


def asked(spark, d) -> DataFrame:
    n = F.col("claim_no")
    which = F.filter(F.array(F.when(n % 4 == 0, 0), F.lit(1), F.when(n % 9 == 1, 2)), lambda x: x.isNotNull())
    tier = times.reservation_tier(times.seconds_between(F.col("not_before"), B.at_lit()))
    return B.outbox(spark, d).withColumn("tier", tier).withColumn("n", F.explode(which)).select(
        F.concat("idempotency_key", F.when(F.col("n") == 0, "").otherwise(":2")).alias("idempotency_key"), (n * 4 + F.col("n")).alias("ord"), "subject_token", "claim_id", "action", "tier")


def batch(spark, d) -> tuple[DataFrame, DataFrame]:
    """Outcomes and next reservations; the caps are those of ``a21_remaining_budget``."""
    after = []

    def build():
        r = reservations(spark, d)
        outcomes, nxt = R.reserve(asked(spark, d), r, r.groupBy("budget").agg(F.sum("amount").alias("cap")))
        after.append(nxt)
        return outcomes
    outcomes = staged(spark, d, "asked", build)
    return outcomes, staged(spark, d, "reserved", lambda: after[0])


_DIMS = list(zip(dims.BUDGETS, dims.COST_COLUMNS))
_FITS = " and ".join(f"(o.{c} = 0 or a.{b} + o.{c} <= l.{b})" for b, c in _DIMS)
_RESERVE = f"""{_CAPS}, hold as (select budget, sum(amount) as held from reservations where status = 'hard' group by 1),
      l as materialized (select {', '.join(f"cast(coalesce(max(cap - coalesce(held, 0)) filter (where budget = '{b}'), 0) as bigint) as {b}" for b in dims.BUDGETS)} from caps left join hold using (budget)),
      cost as (select action, {', '.join(dims.COST_COLUMNS)}, {' + '.join(dims.COST_COLUMNS)} > 0 as asks from action_dim),
      fresh as (select idempotency_key, min(ord) as first_ord from asked where idempotency_key not in (select idempotency_key from reservations) group by 1),
      o as materialized (select q.*, cost.*, row_number() over (order by ord) as place from asked q join fresh f on f.idempotency_key = q.idempotency_key and f.first_ord = q.ord join cost on cost.action = q.action where asks and tier = 'hard'),
      fold as (select cast(0 as bigint) as place, cast('' as varchar) as k, false as ok, {', '.join(f"cast(0 as bigint) as {b}" for b in dims.BUDGETS)}
        union all select o.place, o.idempotency_key, {_FITS}, {', '.join(f"a.{b} + case when {_FITS} then o.{c} else 0 end" for b, c in _DIMS)} from fold a join o on o.place = a.place + 1, l)"""


@query("m24_batch_reservation", f"""with recursive {_RESERVE} select q.ord, q.claim_id, q.action, case when not asks then 'free' when f.idempotency_key is null then 'reused' when (q.tier = 'soft' or fold.ok) and q.ord > f.first_ord then 'reused'
      when q.tier = 'soft' then 'soft' when fold.ok then 'hard' else 'refused' end as outcome from asked q join cost on cost.action = q.action left join fresh f on f.idempotency_key = q.idempotency_key left join fold on fold.k = q.idempotency_key""")
def m24(spark, d):
    """A batch of requests against what is left of six caps, each whole or not at all, each key once."""
    return batch(spark, d)[0].select("ord", "claim_id", "action", "outcome")


@query("m24_reserved_budgets", f"""with recursive {_RESERVE}, rows_after as (select budget, status, amount from reservations union all select b.budget, 'hard', b.amount from o join fold on fold.k = o.idempotency_key and ok cross join lateral (select unnest([{', '.join(f"'{b}'" for b in dims.BUDGETS)}]) as budget, unnest([{', '.join(f'o.{c}' for c in dims.COST_COLUMNS)}]) as amount) b where b.amount > 0
        union all select b.budget, 'soft', b.amount from fresh f join asked q on q.idempotency_key = f.idempotency_key and q.ord = f.first_ord and q.tier = 'soft' join cost on cost.action = q.action cross join lateral (select unnest([{', '.join(f"'{b}'" for b in dims.BUDGETS)}]) as budget, unnest([{', '.join(f'cost.{c}' for c in dims.COST_COLUMNS)}]) as amount) b where b.amount > 0)
      select budget, status, count(*) as n, cast(sum(amount) as bigint) as amount from rows_after group by 1, 2""")
def m24_budgets(spark, d):
    return batch(spark, d)[1].groupBy("budget", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


# ---- money ----------------------------------------------------------------------------------------------
@query("a15_money_balances", "select coalesce(claim_no, -1) as claim_no, coalesce(account, '*') as account, cast(sum(delta_paise) as bigint) as balance from money_entries group by rollup (claim_no, account)")
def a15(spark, d):
    return S.balances(B.money_entries(spark, d)).select(F.coalesce("claim_no", F.lit(-1)).alias("claim_no"), F.coalesce("account", F.lit("*")).alias("account"), "balance")


@query("a16_unbalanced_groups", "with g as (select group_id, sum(delta_paise) as t from money_entries group by 1) select count(*) as groups, count(*) filter (where t <> 0) as unbalanced from g")
def a16(spark, d):
    e = B.money_entries(spark, d)
    bad = S.unbalanced_groups(e).agg(F.lit(0).cast("long").alias("groups"), F.count(F.lit(1)).alias("unbalanced"))
    n = e.select("group_id").distinct().agg(F.count(F.lit(1)).alias("groups"), F.lit(0).cast("long").alias("unbalanced"))
    return n.unionByName(bad).agg(F.sum("groups").alias("groups"), F.sum("unbalanced").alias("unbalanced"))


@query("f11_money_transition", """with mv as (select *, row_number() over () as rid from (select distinct * from money_moves)),
    legs as (select rid, claim_no, occurred_at, group_id, frm as account, -amount as d, 1 as s from mv union all select rid, claim_no, occurred_at, group_id, dest, amount, 0 from mv),
    run as (select *, sum(d) over (partition by claim_no, account order by occurred_at, group_id, s rows unbounded preceding) as aft from legs),
    j as (select m.*, r.aft + m.amount as available, e.frm is not null as legal from mv m join run r on r.rid = m.rid and r.s = 1 left join money_edges e on e.frm = m.frm and e.dest = m.dest)
    select frm, case when not legal then 'illegal' when frm <> 'external' and amount > available then 'insufficient' else 'ok' end as outcome, count(*) as n, cast(sum(amount) as bigint) as amount from j group by 1, 2""")
def f11(spark, d):
    e = B.money_entries(spark, d)
    m = e.filter(F.col("delta_paise") <= 0).select("group_id", "claim_no", "occurred_at", F.col("account").alias("frm"), (-F.col("delta_paise")).alias("amount"))
    t = e.filter(F.col("delta_paise") > 0).select("group_id", "claim_no", "occurred_at", F.col("account").alias("to"), F.col("delta_paise").alias("amount"))
    mv = m.join(t, ["group_id", "claim_no", "occurred_at", "amount"]).distinct()
    out = S.money_moves(mv, F.to_date("occurred_at"))
    return out.groupBy("frm", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


# ---- ledger ----------------------------------------------------------------------------------------------
CTES["entries"] = """select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_type, '{"event":' || event_id || ',"kind":"' || event_type || '","seq":' || row_number() over (partition by user_id order by ts, event_id) || '}' as body from events"""
_FOLD = """seg as (select user_id, seq, event_id, event_type, body, (seq - 1) // 256 as segment, (seq - 1) % 256 as p from entries),
    ch as (select user_id, segment, p, seq, event_id, event_type, body, '0000000000000000000000000000000000000000000000000000000000000000' as prev_hash, sha256(unhex('0000000000000000000000000000000000000000000000000000000000000000') || encode(body)) as entry_hash from seg where p = 0
      union all select s.user_id, s.segment, s.p, s.seq, s.event_id, s.event_type, s.body, c.entry_hash, sha256(unhex(c.entry_hash) || encode(s.body)) from ch c join seg s on s.user_id = c.user_id and s.segment = c.segment and s.p = c.p + 1)"""


def entries(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return S.segmented(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.to_date("ts"))


def _body():
    return F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('","seq":'), F.col("seq").cast("string"), F.lit("}"))


def ledger(spark, d) -> DataFrame:
    """The stored ledger, with some bodies altered after hashing and some inner numbers shifted."""
    def build():
        c = S.chain(entries(spark, d), ["user_id"], _body())
        ev = F.get_json_object("body", "$.event").cast("long")
        c = c.withColumn("event_id", ev).withColumn("event_type", F.get_json_object("body", "$.kind"))
        return c.withColumn("body", F.when(ev % 97 == 0, F.regexp_replace("body", '"kind":"', '"kind":"x')).otherwise(F.col("body")))
    return staged(spark, d, "ledger", build)


@query("w11_chain_fold", f"with recursive {_FOLD} select user_id, segment, count(*) as entries, arg_max(entry_hash, p) as head from ch group by 1, 2")
def w11(spark, d):
    return S.chain_heads(entries(spark, d), ["user_id"], _body()).select("user_id", "segment", F.col("entries").cast("long").alias("entries"), "head")


@query("w10_ledger_verify", "select user_id, seq, case when event_id % 97 = 0 then 'body' else '' end as breaks from entries")
def w10(spark, d):
    v = S.verify(ledger(spark, d), ["user_id"], F.get_json_object("body", "$.seq").cast("long"))
    return v.select("user_id", "seq", F.array_join("breaks", ",").alias("breaks"))


@query("s12_ledger_scans", """with recursive """ + _FOLD + """, h as (select user_id, max(seq) as head_seq, arg_max(entry_hash, seq) as head_hash, count(*) filter (where event_type = 'purchase') as of_type, string_agg(event_id, ',' order by seq) as replay from ch group by 1)
      select user_id, head_seq, head_hash, of_type, sha256(replay) as replay_hash from h""".replace("head_hash, of_type, sha256(replay) as replay_hash", "head_hash, of_type"))
def s12(spark, d):
    l = ledger(spark, d)
    return l.groupBy("user_id").agg(F.max("seq").alias("head_seq"), F.max_by("entry_hash", "seq").alias("head_hash"), F.count_if(F.col("event_type").endswith("purchase")).alias("of_type"))


@query("s12_replay", "select user_id, seq, event_id from entries where event_type = 'purchase'")
def s12r(spark, d):
    l = ledger(spark, d).filter(F.col("event_type") == "purchase").orderBy("user_id", "seq")
    return l.select("user_id", "seq", "event_id")


# ---- personal records and erasure ------------------------------------------------------------------------
def keys(spark, d) -> DataFrame:
    """A data key per customer; some are destroyed, some customers never had one."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").filter(k % 20 != 7)
    key = F.unhex(F.substring(F.sha2(F.concat(F.lit("key"), k.cast("string")), 256), 1, 32))
    return c.select(B.token_of(k).alias("subject_token"), F.when(k % 20 != 3, key).alias("data_key"))


@query("s13_subject_records", "select subject_token, case when cust % 20 = 7 then 'unknown' when cust % 20 = 3 then 'shredded' else 'readable' end as status, case when cust % 20 in (3, 7) then '' else segment end as plain from subjects")
def s13(spark, d):
    def build():
        c = table(spark, d, "customer")
        k = F.col("c_custkey")
        key = F.unhex(F.substring(F.sha2(F.concat(F.lit("key"), k.cast("string")), 256), 1, 32))
        return c.select(B.token_of(k).alias("subject_token"), S.encrypt(F.col("c_mktsegment").cast("binary"), key, B.token_of(k)).alias("cipher"))
    records = staged(spark, d, "records", build)
    return S.read_record(records, keys(spark, d)).select("subject_token", "status", F.coalesce("plain", F.lit("")).alias("plain"))


@query("j16_shredded_or_unknown", "select case when cust % 20 = 7 then 'unknown' when cust % 20 = 3 then 'shredded' else 'readable' end as status, count(*) as n from subjects group by 1")
def j16(spark, d):
    return s13(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def erased(spark, d) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_custkey") % 53 == 0).select(B.token_of(F.col("c_custkey")).alias("subject_token"))


@query("j18_erasure_sweep", """select 'claims' as target, count(*) filter (where cust % 53 <> 0) as kept, count(*) filter (where cust % 53 = 0) as swept from claims union all select 'outbox', count(*) filter (where cust % 53 <> 0), count(*) filter (where cust % 53 = 0) from outbox
      union all select 'retries', count(*) filter (where cust % 53 <> 0 or cust >= (select count(*) from customer)), count(*) filter (where cust % 53 = 0 and cust < (select count(*) from customer)) from retries""")
def j18(spark, d):
    gone, out = erased(spark, d), None
    for name, t in [("claims", B.claims(spark, d)), ("outbox", B.outbox(spark, d)), ("retries", B.retries(spark, d))]:
        t = t.select("subject_token")
        kept = S.erase(t, gone).agg(F.count(F.lit(1)).alias("kept"), F.lit(0).cast("long").alias("swept"))
        swept = t.join(gone, "subject_token", "left_semi").agg(F.lit(0).cast("long").alias("kept"), F.count(F.lit(1)).alias("swept"))
        one = kept.unionByName(swept).agg(F.sum("kept").alias("kept"), F.sum("swept").alias("swept")).withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("j19_erasure_residual", "select 'claims' as target, 0 as residual, count(*) filter (where cust % 53 <> 0) as rows from claims union all select 'outbox', 0, count(*) filter (where cust % 53 <> 0) from outbox")
def j19(spark, d):
    gone, out = erased(spark, d), None
    for name, t in [("claims", B.claims(spark, d)), ("outbox", B.outbox(spark, d))]:
        left = S.erase(t.select("subject_token"), gone)
        x = left.join(gone.withColumn("_g", F.lit(1)), "subject_token", "left").agg(F.count("_g").cast("int").alias("residual"), F.count(F.lit(1)).alias("rows")).withColumn("target", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


@query("m27_erasure_run", f"""select subject_token, count(*) filter (where status in ('pending', 'in_flight', 'failed')) as outbox_cancelled, count(*) as claims_purged, true as key_destroyed, sha256('tombstone' || subject_token) as tombstone from outbox where cust % 53 = 0 group by 1""")
def m27(spark, d):
    """Stop future work, destroy the key, sweep, leave a tombstone: one report row per erased subject."""
    gone = erased(spark, d)
    o = B.outbox(spark, d).join(gone, "subject_token", "left_semi").groupBy("subject_token").agg(
        F.count_if(F.col("status").isin("pending", "in_flight", "failed")).alias("outbox_cancelled"), F.count(F.lit(1)).alias("claims_purged"))
    after = keys(spark, d).join(gone.withColumn("_g", F.lit(True)), "subject_token", "left").withColumn("data_key", F.when(F.col("_g").isNull(), F.col("data_key")))
    j = o.join(after.select("subject_token", F.col("data_key").isNull().alias("_dead")), "subject_token", "left")
    return j.select("subject_token", "outbox_cancelled", "claims_purged", F.coalesce("_dead", F.lit(True)).alias("key_destroyed"), F.sha2(F.concat(F.lit("tombstone"), "subject_token"), 256).alias("tombstone"))


@query("t08_erasure_history", "select subject_token, claim_no, row_number() over (partition by subject_token order by detected_at, claim_no) as n from claims where cust % 53 = 0")
def t08(spark, d):
    req = B.claims(spark, d).join(erased(spark, d), "subject_token", "left_semi")
    return scale.running(req.select("subject_token", "claim_no", "detected_at"), ["subject_token"], F.to_date("detected_at"), [F.col("detected_at"), F.col("claim_no")], rank="n", split=scale.BUCKET_ROWS).select("subject_token", "claim_no", "n")


# ---- stop events ---------------------------------------------------------------------------------------
CTES["stops"] = f"""select event_id as event_seq, {pick(list(dims.EVENT_MATCH), 'k % 10')} as name, ts_key.* from (select event_id, k, user_id, at_ts as occurred_at, 'clm-' || lpad(cast(user_id as varchar), 12, '0') as claim_id, 'sub_' || substr(sha256(cast(user_id as varchar)), 1, 32) as subject_token from presentations) ts_key"""


def stops(spark, d) -> DataFrame:
    p = B.presentations(spark, d)
    return p.select(F.col("event_id").alias("event_seq"), F.get(F.array(*map(F.lit, list(dims.EVENT_MATCH))), F.col("k") % 10).alias("name"), F.col("at_ts").alias("occurred_at"),
                    F.concat(F.lit("clm-"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("claim_id"), B.token_of(F.col("user_id")).alias("subject_token"))


_MATCH = "case when name in ('claim.recovered', 'claim.disputed', 'claim.retry_scheduled', 'claim.needs_allocation', 'ptp.recorded') then claim_id when name = 'system.freeze' then 'default' else subject_token end"


@query("n10_match_key", f"select event_seq, name, {_MATCH} as match_key from stops")
def n10(spark, d):
    return stops(spark, d).select("event_seq", "name", S.stop_key(F.col("name"), F.col("claim_id"), F.col("subject_token"), F.lit("default")).alias("match_key"))


_RUNS = "runs as (select user_id as run_id, 'clm-' || lpad(cast(user_id as varchar), 12, '0') as claim_id, 'sub_' || substr(sha256(cast(user_id as varchar)), 1, 32) as subject_token, min(ts) + interval 10 day as since from events group by 1)"
_SUBS = f"subs as (select run_id, since, n.name, case when n.name in ('claim.recovered', 'claim.disputed') then claim_id when n.name = 'system.freeze' then 'default' else subject_token end as match_key from runs, (select unnest({dims.STOP_EVENTS!r}) as name) n)"


def runs(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.min("ts") + F.expr("interval 10 days")).alias("since")).withColumn(
        "claim_id", F.concat(F.lit("clm-"), F.lpad(F.col("run_id").cast("string"), 12, "0"))).withColumn("subject_token", B.token_of(F.col("run_id")))


def subscriptions(runs_: DataFrame) -> DataFrame:
    s = runs_.withColumn("name", F.explode(F.array(*map(F.lit, dims.STOP_EVENTS))))
    return s.select("run_id", "since", "name", S.stop_key(F.col("name"), F.col("claim_id"), F.col("subject_token"), F.lit("default")).alias("match_key"))


@query("j14_earliest_stop", f"with {_RUNS}, {_SUBS}, ev as (select *, {_MATCH} as match_key from stops), h as (select s.run_id, e.name, e.event_seq, row_number() over (partition by s.run_id order by e.occurred_at, e.event_seq) as rn from subs s join ev e on e.name = s.name and e.match_key = s.match_key and e.occurred_at >= s.since) select run_id, name, event_seq from h where rn = 1")
def j14(spark, d):
    ev = stops(spark, d).withColumn("match_key", S.stop_key(F.col("name"), F.col("claim_id"), F.col("subject_token"), F.lit("default")))
    return S.earliest_stop(subscriptions(runs(spark, d)), ev).select("run_id", "name", "event_seq")


@query("u06_stop_set_complete", f"with h as (select subject_token, list_distinct(list(name)) as have from stops group by 1) select subject_token, coalesce(list_aggregate(list_sort(list_filter({dims.STOP_EVENTS!r}, lambda x: not list_contains(have, x))), 'string_agg', ','), '') as missing from h")
def u06(spark, d):
    h = stops(spark, d).groupBy("subject_token").agg(F.collect_set("name").alias("have"))   # at most ten names
    return h.select("subject_token", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, dims.STOP_EVENTS)), "have")), ",").alias("missing"))


# ---- provider answers ------------------------------------------------------------------------------------
_PROV = f"""prov as (select claim_id, idempotency_key, {pick([p for p, _ in dims.PROVIDER_STATUS] + ['gibberish'], 'claim_no % 8')} as provider_status, channel from outbox join action_dim using (action) where status = 'sent')"""


def provider(spark, d) -> DataFrame:
    o = B.outbox(spark, d).filter(F.col("status") == "sent")
    names = [p for p, _ in dims.PROVIDER_STATUS] + ["gibberish"]
    return o.select("claim_id", "idempotency_key", F.get(F.array(*map(F.lit, names)), (F.col("claim_no") % 8).cast("int")).alias("provider_status"), dims.lookup(F.col("action"), dims.CHANNEL_OF).alias("channel"))


@query("j25_provider_outcome", f"with {_PROV} select claim_id, coalesce(outcome, 'UNKNOWN_STATUS') as outcome, coalesce(outcome in ('opted_out', 'wrong_number'), false) as affects_consent from prov left join provider_dim using (provider_status)")
def j25(spark, d):
    dim = dims.small(spark, dims.PROVIDER_STATUS, "provider_status string, outcome string")
    j = provider(spark, d).join(F.broadcast(dim), "provider_status", "left")
    return j.select("claim_id", F.coalesce("outcome", F.lit("UNKNOWN_STATUS")).alias("outcome"), F.coalesce(F.col("outcome").isin("opted_out", "wrong_number"), F.lit(False)).alias("affects_consent"))


@query("a40_provider_counts", f"with {_PROV} select provider_status, count(*) as n, count(*) - count(distinct channel || substr(claim_id, 15)) as duplicate_keys from prov group by 1")
def a40(spark, d):
    p = provider(spark, d).withColumn("key", F.concat("channel", F.substring("claim_id", 15, 99)))
    u = p.select("provider_status", "key").distinct().groupBy("provider_status").agg(F.count(F.lit(1)).alias("u"))
    return p.groupBy("provider_status").agg(F.count(F.lit(1)).alias("n")).join(u, "provider_status").select("provider_status", "n", (F.col("n") - F.col("u")).alias("duplicate_keys"))


# ---- breakers ---------------------------------------------------------------------------------------------
_DAY = """dayagg as (select cast(at_ts as date) as day, count(*) filter (where contact) as contacts, count(*) as n, 1000.0 * count(*) filter (where complained) / count(*) filter (where contact) as complaint, 1000.0 * count(*) filter (where opted_out) / count(*) filter (where contact) as optout,
      avg(case when adverse then 1.0 else 0.0 end) as adverse, avg(case when k % 50 = 0 then 1.0 else 0.0 end) as veto, avg(case when k % 4 = 0 then 1.0 else 0.0 end) as degraded, avg(case when paid then 0.0 else 1.0 end) as fail from arm_rows group by 1),
    reading as (select day, u.breaker_id, u.observed, contacts as sample from dayagg cross join lateral (values ('CB-COMPLAINT', complaint), ('CB-OPTOUT', optout), ('CB-CANCEL', adverse), ('CB-VOLUME', cast(contacts as double)), ('CB-VETO', veto), ('CB-DEGRADED', degraded), ('CB-COHORT-BLIND', degraded * 2), ('CB-CHANNEL-FAIL', fail), ('CB-RESUME-RAMP', contacts / 100.0), ('CB-SENTIMENT', adverse)) u(breaker_id, observed)),
    based as (select r.*, (select quantile_cont(p.observed, 0.5) from reading p where p.breaker_id = r.breaker_id and p.day < r.day and p.day >= r.day - 7) as baseline from reading r),
    judged2 as (select b.*, s.comparison, case when sample > 0 and sample < 30 then null when comparison = 'ratio_of_baseline' then case when baseline is null or baseline <= 0 then null else threshold * baseline end else threshold end as lim from based b join breaker_specs s using (breaker_id)),
    jt as (select *, coalesce(observed > lim, false) as tripped from judged2)"""


def readings(spark, d) -> DataFrame:
    from dunlin.plans.q_measure import arm_rows
    from pyspark.sql.window import Window as W
    r = arm_rows(spark, d).groupBy(F.to_date("at_ts").alias("evaluated_on")).agg(
        F.count_if("contact").alias("sample"), F.count_if("complained").alias("c"), F.count_if("opted_out").alias("o"), F.avg(F.col("adverse").cast("double")).alias("adverse"),
        F.avg((F.col("k") % 50 == 0).cast("double")).alias("veto"), F.avg((F.col("k") % 4 == 0).cast("double")).alias("degraded"), F.avg((~F.col("paid")).cast("double")).alias("fail"))
    obs = {"CB-COMPLAINT": F.try_divide(1000.0 * F.col("c"), F.col("sample")), "CB-OPTOUT": F.try_divide(1000.0 * F.col("o"), F.col("sample")), "CB-CANCEL": F.col("adverse"),
           "CB-VOLUME": F.col("sample").cast("double"), "CB-VETO": F.col("veto"), "CB-DEGRADED": F.col("degraded"), "CB-COHORT-BLIND": F.col("degraded") * 2,
           "CB-CHANNEL-FAIL": F.col("fail"), "CB-RESUME-RAMP": F.col("sample") / 100.0, "CB-SENTIMENT": F.col("adverse")}
    x = r.select("evaluated_on", "sample", F.inline(F.array(*[F.struct(F.lit(b).alias("breaker_id"), c.alias("observed")) for b, c in obs.items()])))
    w = W.partitionBy("breaker_id").orderBy(F.unix_date("evaluated_on")).rangeBetween(-7, -1)     # a row per day
    return x.withColumn("baseline", F.expr("percentile(observed, 0.5)").over(w))


@query("w21_trailing_median", f"with {_DAY} select strftime(day, '%Y-%m-%d') as day, breaker_id, round(observed, 6) as observed, coalesce(round(baseline, 6), -1) as baseline, sample from based")
def w21(spark, d):
    return readings(spark, d).select(F.date_format("evaluated_on", "yyyy-MM-dd").alias("day"), "breaker_id", F.round("observed", 6).alias("observed"), F.coalesce(F.round("baseline", 6), F.lit(-1.0)).alias("baseline"), "sample")


def judged(spark, d) -> DataFrame:
    specs = dims.small(spark, dims.BREAKERS, "breaker_id string, metric string, comparison string, threshold double, self_monitoring boolean")
    return S.judge(readings(spark, d), specs)


@query("m17_breakers", f"with {_DAY} select strftime(day, '%Y-%m-%d') as day, breaker_id, tripped, coalesce(round(lim, 6), -1) as lim from jt")
def m17(spark, d):
    return judged(spark, d).select(F.date_format("evaluated_on", "yyyy-MM-dd").alias("day"), "breaker_id", "tripped", F.coalesce(F.round("limit", 6), F.lit(-1.0)).alias("lim"))


@query("w17_breaker_transitions", f"with {_DAY}, l as (select *, tripped and not coalesce(lag(tripped) over (partition by breaker_id order by day), false) as newly from jt) select strftime(day, '%Y-%m-%d') as day, breaker_id, newly, coalesce(case when tripped then strftime(max(case when newly then day end) over (partition by breaker_id order by day), '%Y-%m-%d') end, '') as tripped_on from l")
def w17(spark, d):
    h = S.breaker_history(judged(spark, d))
    return h.select(F.date_format("evaluated_on", "yyyy-MM-dd").alias("day"), "breaker_id", "newly", F.coalesce(F.date_format("tripped_on", "yyyy-MM-dd"), F.lit("")).alias("tripped_on"))


# ---- promises -----------------------------------------------------------------------------------------------
_PAT = "timestamp '2001-07-01'"
_PO = f"""po as (select p.*, f.paid_at, p.due_at + interval 36 hour as deadline, case when f.paid_at <= p.due_at + interval 36 hour then 'kept' when f.paid_at is not null then 'broken' when {_PAT} <= p.due_at + interval 36 hour then 'unresolved' else 'broken' end as outcome
      from promises p left join (select claim_no, min(paid_at) as paid_at from payments group by 1) f using (claim_no))"""


def promise_rows(spark, d) -> DataFrame:
    return S.promise_outcomes(B.promises(spark, d), B.payments(spark, d), F.lit("2001-07-01").cast("timestamp"))


@query("j15_promise_outcome", f"with {_PO} select claim_no, outcome, coalesce(epoch_us(paid_at), -1) as paid_us from po")
def j15(spark, d):
    return promise_rows(spark, d).select("claim_no", "outcome", F.coalesce(F.unix_micros("paid_at"), F.lit(-1)).alias("paid_us"))


@query("a34_close_at_horizon", f"select case when due_at >= timestamp '2001-06-15' then 'unresolved' else 'due' end as status, count(*) as n from promises group by 1")
def a34(spark, d):
    h = F.lit("2001-06-15").cast("timestamp")
    return B.promises(spark, d).groupBy(F.when(F.col("due_at") >= h, "unresolved").otherwise("due").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a36_drift_report", """with m as (select 'decline_rate' as metric, avg(case when succeeded then 0.0 else 1.0 end) as measured from presentations union all select 'card_share', avg(case when rail = 'card' then 1.0 else 0.0 end) from presentations
      union all select 'in_treatment_share', avg(case when state = 'in_treatment' then 1.0 else 0.0 end) from claims union all select 'voice_contact_share', avg(case when channel = 'voice' then 1.0 else 0.0 end) from contacts),
      a(metric, anchor, tolerance) as (values ('decline_rate', 0.20, 0.03), ('card_share', 0.33, 0.05), ('in_treatment_share', 0.33, 0.02), ('voice_contact_share', 0.10, 0.02))
      select metric, round(measured, 6) as measured, abs(measured - anchor) <= tolerance as within from m join a using (metric)""")
def a36(spark, d):
    p, c, k = B.presentations(spark, d), B.claims(spark, d), B.contacts(spark, d)

    def share(df, cond, name):
        return df.agg(F.avg(cond.cast("double")).alias("measured")).withColumn("metric", F.lit(name))
    m = share(p, ~F.col("succeeded"), "decline_rate").unionByName(share(p, F.col("rail") == "card", "card_share")).unionByName(
        share(c, F.col("state") == "in_treatment", "in_treatment_share")).unionByName(share(k, F.col("channel") == "voice", "voice_contact_share"))
    anchors = dims.small(spark, [("decline_rate", 0.20, 0.03), ("card_share", 0.33, 0.05), ("in_treatment_share", 0.33, 0.02), ("voice_contact_share", 0.10, 0.02)], "metric string, anchor double, tolerance double")
    return m.join(F.broadcast(anchors), "metric").select("metric", F.round("measured", 6).alias("measured"), (F.abs(F.col("measured") - F.col("anchor")) <= F.col("tolerance")).alias("within"))


@query("u08_missing_rules", "with f as (select distinct rule_id from (select unnest(['ABS-CONSENT', 'TIME-WINDOW', 'NET-CAT1']) as rule_id, unnest(['sms', 'voice_call', 'retry']) as action) x join decisions d on d.action = x.action) select 33 - count(*) as missing from f")
def u08(spark, d):
    """Rules of the table that a report over the decisions does not show."""
    from dunlin.sources import ruleset
    shown = dims.small(spark, [("ABS-CONSENT", "sms"), ("TIME-WINDOW", "voice_call"), ("NET-CAT1", "retry")], "rule_id string, action string")
    seen = B.decisions(spark, d).select("action").distinct().join(F.broadcast(shown), "action").select("rule_id").distinct()
    return ruleset.rule_dim(spark).join(seen, "rule_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
