"""Ingest queries: deliveries to claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, stats, times
from dunlin.operators import ingest, scale
from dunlin.plans.q_functions import _hmac_sql, _uuid_sql
from dunlin.plans.registry import query
from dunlin.plans.sqlbridge import AT
from dunlin.session import scratch_path, staged, table
from dunlin.sources import bridge as B
from dunlin.sources import dialects

def ltv_of():
    return F.col("amount_paise") * 12


def admitted(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "admitted", lambda: ingest.admit(B.deliveries(spark, d), B.SECRETS))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return staged(spark, d, "judged", lambda: ingest.classify(B.deliveries(spark, d), B.SECRETS))


def accepted(spark, d) -> DataFrame:
    return ingest.accepted_events(admitted(spark, d))


def folded(spark, d) -> DataFrame:
    return ingest.fold_by_account(accepted(spark, d))


def normalised(spark, d) -> DataFrame:
    return staged(spark, d, "normalised", lambda: ingest.normalise(folded(spark, d), B.PEPPER, ltv_of()))


# ---- admission --------------------------------------------------------------------------------
@query("s01_admit", "select archive_id, src as source, verdict from admitted")
def s01(spark, d):
    return admitted(spark, d).select("archive_id", "source", "verdict")


@query("a04_ingest_counters", """
    select count(*) as delivered, count(*) filter (where verdict = 'signature_invalid') as rejected_signature, count(*) filter (where verdict = 'signature_stale') as stale_signature,
      count(*) filter (where verdict = 'unknown_source') as unknown_source, count(*) filter (where verdict = 'malformed') as parse_failures,
      count(*) filter (where verdict = 'duplicate') as deduplicated, count(*) filter (where verdict = 'accepted') as accepted, 0 as tripped from admitted""")
def a04(spark, d):
    v = F.col("verdict")
    names = [("rejected_signature", "signature_invalid"), ("stale_signature", "signature_stale"), ("unknown_source", "unknown_source"),
             ("parse_failures", "malformed"), ("deduplicated", "duplicate"), ("accepted", "accepted"), ("tripped", "tripped")]
    return admitted(spark, d).agg(F.count(F.lit(1)).alias("delivered"), *[F.count_if(v == x).alias(n) for n, x in names])


@query("h05_signature", "select archive_id, not tampered and src <> 'mystery' as valid, sec + copy * 60 - case when old then 259200 else 0 end as signed_at_s from wire")
def h05(spark, d):
    dl = B.deliveries(spark, d)
    return dl.select("archive_id", hashing.signature_ok(F.col("raw"), F.col("signature"), F.col("source"), B.SECRETS).alias("valid"),
                     F.unix_seconds(hashing.signed_at(F.col("signature"))).alias("signed_at_s"))


_PARSED = """eid as event_id, cast(floor(epoch_us({ts}) / 1000000) as bigint) as event_s, kind, wire_rail as rail, account_ref, amount_paise,
      kind = 'debit_captured' as succeeded, cast(case when k % 3 = 0 then 1 else k % 3 end as bigint) as attempt,
      case when src <> 'billing' and k % 4 = 0 then 'gateway' else 'merchant' end as initiated_by,
      coalesce(case when src <> 'billing' then code end, '') as decline_code, coalesce(case when src = 'pgw' then advice end, '') as advice_code,
      coalesce(case when src <> 'billing' then issuer_ref end, '') as issuer_ref, coalesce(case when src = 'pgw' then 'cust_' || user_id end, '') as customer_ref,
      case when src in ('pgw', 'billing') then 'u' || user_id || '@example.com' else '' end as email, '98' || lpad(cast(user_id as varchar), 8, '0') as phone,
      coalesce(case when src in ('npci_nach', 'upi_autopay') then 'UMRN' || user_id end, '') as mandate"""
_DATE_TS = "case when src = 'npci_nach' then date_trunc('day', at_ts) else event_ts end"


def _flat(events: DataFrame, prefix: str = "") -> DataFrame:
    c = lambda n: F.col(prefix + n)
    blank = lambda x: F.coalesce(x, F.lit(""))
    return events.select(
        "archive_id", c("event_id").alias("event_id"), F.unix_seconds(c("event_ts")).alias("event_s"), c("kind").alias("kind"), c("rail").alias("rail"),
        c("account_ref").alias("account_ref"), c("amount_paise").alias("amount_paise"), c("succeeded").alias("succeeded"), c("attempt").alias("attempt"),
        c("initiated_by").alias("initiated_by"), blank(c("decline_code")).alias("decline_code"), blank(c("advice_code")).alias("advice_code"),
        blank(c("issuer_ref")).alias("issuer_ref"), blank(c("customer_ref")).alias("customer_ref"), blank(c("personal.email")).alias("email"),
        c("personal.phone").alias("phone"), blank(F.try_element_at(c("personal.identifiers"), F.lit("mandate"))).alias("mandate"))


def _dialect(spark, d, source: str) -> DataFrame:
    rows = B.deliveries(spark, d).filter(F.col("source") == source)
    return _flat(dialects.parse(rows, [source]).filter(F.col("event").isNotNull()), "event.")


for _key, _src in [("s02_card_dialect", "pgw"), ("s03_nach_dialect", "npci_nach"), ("s04_upi_dialect", "upi_autopay"), ("s05_billing_dialect", "billing")]:
    query(_key, f"select archive_id, {_PARSED.format(ts=_DATE_TS)} from judged where src = '{_src}' and not broken")(
        lambda spark, d, _s=_src: _dialect(spark, d, _s))


@query("s06_dispatch", "select src as source, src <> 'mystery' as known, count(*) as deliveries, count(*) filter (where src <> 'mystery' and not broken) as parsed from wire group by 1, 2")
def s06(spark, d):
    p = dialects.parse(B.deliveries(spark, d))
    return p.groupBy("source", F.col("known_source").alias("known")).agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(F.col("event").isNotNull()).alias("parsed"))


def write_archive(spark, d) -> tuple[DataFrame, DataFrame]:
    """Append the raw bodies partitioned by source, and the outcome as a second, narrow table."""
    adm = admitted(spark, d)
    path = scratch_path(spark, "archive")
    raw = adm.select("archive_id", "source", "raw", "signature", "received_at", "signature_valid")
    raw.write.partitionBy("source").mode("append").parquet(path)
    back = spark.read.schema("archive_id long, raw binary, signature string, received_at timestamp, signature_valid boolean, source string").parquet(path)
    notes = adm.select("archive_id", F.col("event.event_id").alias("event_id"),
                       F.when(~F.col("verdict").isin("accepted", "duplicate"), F.col("verdict")).alias("parse_error"))
    return back, notes


@query("s07_archive", """select archive_id, src as source, case when src = 'mystery' or broken then '' else eid end as event_id,
      case when verdict in ('accepted', 'duplicate') then '' else verdict end as parse_error from admitted""")
def s07(spark, d):
    raw, notes = write_archive(spark, d)
    return raw.join(notes, "archive_id").select("archive_id", "source", F.coalesce("event_id", F.lit("")).alias("event_id"), F.coalesce("parse_error", F.lit("")).alias("parse_error"))


@query("s08_replay_source", "select archive_id, broken as unreadable from wire where src = 'upi_autopay' and not tampered")
def s08(spark, d):
    raw, _ = write_archive(spark, d)
    one = raw.filter((F.col("source") == "upi_autopay") & F.col("signature_valid")).orderBy("archive_id")
    return one.select("archive_id", (F.decode("raw", "utf-8") == "{broken").alias("unreadable"))


# ---- dedupe and order ---------------------------------------------------------------------------
@query("w03_dedupe_window", f"""
    with seen as (select src as source, eid, min(at_ts) as first_seen from judged where pre = 'accepted' and copy = 0 and k % 6 < 3 group by 1, 2),
    acc as (select src as source, eid, min(archive_id) as archive_id from judged where pre = 'accepted' group by 1, 2)
    select a.archive_id, not (s.first_seen is not null and s.first_seen - case when a.archive_id % 4 < 2 then interval 20 day else interval 0 day end >= timestamp '2024-02-09' - interval 30 day) as is_new
    from acc a left join seen s on a.source = s.source and a.eid = s.eid""")
def w03(spark, d):
    rows = classified(spark, d)
    p = B.presentations(spark, d).select("event_id", "at_ts", "k")
    acc = rows.filter(F.col("verdict") == "accepted")
    seen = acc.filter(F.col("archive_id") % 2 == 0).withColumn("event_no", F.floor(F.col("archive_id") / 2)).join(
        p.withColumnRenamed("event_id", "event_no"), "event_no").filter(F.col("k") % 6 < 3).select(
        "source", F.col("event.event_id").alias("event_id"),
        times.add_seconds(F.col("at_ts"), F.when(F.col("archive_id") % 4 < 2, -20 * 86400.0).otherwise(0.0)).alias("first_seen_at"))
    out = ingest.dedupe(acc, seen, F.lit("2024-02-09").cast("timestamp"))
    first = out.groupBy("source", F.col("event.event_id")).agg(F.min("archive_id").alias("archive_id"), F.bool_or(F.col("verdict") == "accepted").alias("is_new"))
    return first.select("archive_id", "is_new")


@query("w01_event_order", "select eid as event_id, row_number() over (partition by account_ref order by event_ts, src, eid) as position from accepted")
def w01(spark, d):
    return ingest.event_order(accepted(spark, d), F.to_date("event_ts")).select("event_id", "position")


@query("w02_out_of_order", """
    with o as (select archive_id, coalesce(event_ts < max(event_ts) over (order by archive_id rows between unbounded preceding and 1 preceding), false) as late from accepted)
    select count(*) as events, count(*) filter (where late) as out_of_order from o""")
def w02(spark, d):
    o = ingest.out_of_order(accepted(spark, d))
    return o.agg(F.count(F.lit(1)).alias("events"), F.count_if("out_of_order").alias("out_of_order"))


_FOLD = """
    last as (select *, row_number() over (partition by account_ref order by event_ts desc, src desc, eid desc) as rn from accepted),
    counts as (select account_ref, count(*) as events, count(*) filter (where kind <> 'debit_captured') as failed_attempts from accepted group by 1),
    fold as (select l.*, c.events, c.failed_attempts, l.kind = 'debit_captured' as resolved, l.kind = 'debit_captured' and c.failed_attempts > 0 as superseded
             from last l join counts c using (account_ref) where rn = 1)"""


@query("a03_fold_account", f"with {_FOLD} select account_ref, eid as last_event, failed_attempts, events, resolved, superseded from fold")
def a03(spark, d):
    return folded(spark, d).select("account_ref", F.col("latest.event_id").alias("last_event"), "failed_attempts", "events", "resolved", "superseded")


@query("a11_latest_failure", """
    with f as (select account_ref, event_id, decline_code, row_number() over (partition by account_ref order by at_ts desc, event_id desc) as rn from failures)
    select account_ref, event_id, decline_code from f where rn = 1""")
def a11(spark, d):
    f = B.failures(spark, d)
    return f.groupBy("account_ref").agg(F.max_by(F.struct("event_id", "decline_code"), F.struct("at_ts", "event_id")).alias("x")).select("account_ref", "x.*")


@query("w18_consecutive_failures", """
    with s as (select source, event_id, succeeded, count(*) filter (where succeeded) over (partition by source order by at_ts, event_id) as grp from presentations)
    select event_id, cast(case when succeeded then 0 else count(*) filter (where not succeeded) over (partition by source, grp order by event_id) end as bigint) as fail_run from s""")
def w18(spark, d):
    p = B.presentations(spark, d).select("source", "event_id", "at_ts", "succeeded")
    order = [F.col("at_ts"), F.col("event_id")]
    r = ingest.consecutive_failures(p, ["source"], F.to_date("at_ts"), order, ~F.col("succeeded"), F.col("succeeded"))
    return r.select("event_id", F.when(F.col("succeeded"), F.lit(0)).otherwise(F.col("fail_run")).cast("long").alias("fail_run"))


# ---- redaction boundary ---------------------------------------------------------------------------
_TOKEN = "'sub_' || substr(" + _hmac_sql(B.PEPPER, "encode(case when src = 'pgw' then 'cust_' || user_id else '98' || lpad(cast(user_id as varchar), 8, '0') end)") + ", 1, 32)"
_CLAIM_TYPE = "case when kind = 'invoice_overdue' then 'invoice_overdue' when kind = 'checkout_abandoned' then 'checkout_abandon' when wire_rail = 'card' then 'card_decline' else 'mandate_failure' end"
_NORM = f"""{_FOLD}, norm as (select {_uuid_sql(hashing.CLAIM_SPACE, "src || chr(31) || eid")} as claim_id, {_TOKEN} as subject_token, amount_paise,
      amount_paise * 12 as ltv_remaining_paise, {_CLAIM_TYPE} as claim_type, wire_rail as rail, event_ts as detected_at, eid, account_ref, failed_attempts, user_id, src, kind, k, code, advice, issuer_ref, archive_id
      from fold where not resolved)"""


@query("p01_redaction_split", f"""with {_NORM} select claim_id, subject_token, amount_paise, ltv_remaining_paise, claim_type, rail, cast(floor(epoch_us(detected_at) / 1000000) as bigint) as detected_s,
      'Holder ' || user_id as record_name, '98' || lpad(cast(user_id as varchar), 8, '0') as record_phone, eid as record_event from norm""")
def p01(spark, d):
    n = normalised(spark, d)
    return n.select("claim_id", "subject_token", "amount_paise", "ltv_remaining_paise", "claim_type", "rail", F.unix_seconds("detected_at").alias("detected_s"),
                    F.col("record.name").alias("record_name"), F.col("record.phone").alias("record_phone"), F.col("record.event_id").alias("record_event"))


@query("p02_evidence", f"""with {_NORM}, kv as (
      select claim_id, unnest([['source', src], ['wire_kind', kind], ['rail', rail], ['account_ref', account_ref], ['attempt', cast(case when k % 3 = 0 then 1 else k % 3 end as varchar)],
        ['failed_attempts', cast(failed_attempts as varchar)], ['initiated_by', case when src <> 'billing' and k % 4 = 0 then 'gateway' else 'merchant' end],
        ['decline_code', case when src <> 'billing' then code end], ['advice_code', case when src = 'pgw' then advice end], ['issuer_ref', case when src <> 'billing' then issuer_ref end],
        ['ageing_bucket', case when src = 'billing' then case when k % 60 < 30 then '0-30' else '31-60' end end], ['days_overdue', case when src = 'billing' then cast(k % 60 as varchar) end],
        ['mandate_ref', case when src in ('npci_nach', 'upi_autopay') then 'mnd_' || substr(sha256('UMRN' || user_id), 1, 32) end]]) as p from norm)
      select claim_id, p[1] as name, p[2] as value from kv where p[2] is not null""")
def p02(spark, d):
    return normalised(spark, d).select("claim_id", F.explode("evidence").alias("name", "value"))


@query("p03_identity", f"select archive_id, case when src = 'pgw' then 'cust_' || user_id else '98' || lpad(cast(user_id as varchar), 8, '0') end as identity from accepted")
def p03(spark, d):
    return accepted(spark, d).select("archive_id", ingest.identity().alias("identity"))


@query("p04_claim_type", f"select archive_id, {_CLAIM_TYPE} as claim_type from accepted")
def p04(spark, d):
    return accepted(spark, d).select("archive_id", ingest.claim_type().alias("claim_type"))


@query("f09_claim_validation", f"with {_NORM} select claim_id, case when k % 3 = 0 then 'amount' else '' end as violations from norm")
def f09(spark, d):
    n = normalised(spark, d).withColumn("k", F.get_json_object(F.lit("{}"), "$.k"))
    p = B.presentations(spark, d).select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("eid"), F.col("k").alias("kk"))
    bad = n.join(p, F.col("record.event_id") == p.eid).withColumn("amount_paise", F.when(F.col("kk") % 3 == 0, -F.col("amount_paise") - 1).otherwise(F.col("amount_paise")))
    return bad.select("claim_id", F.array_join(ingest.claim_violations(), ",").alias("violations"))


@query("f17_mandate_shape", """
    select user_id, count(*) as n, user_id % 3 <> 0 as ok from presentations group by 1""")
def f17(spark, d):
    p = B.presentations(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ref = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("UMRN"), F.col("user_id").cast("string"))).otherwise(B.mandate_ref_of())
    return p.select("user_id", "n", ref.rlike("^mnd_[0-9a-f]{32}$").alias("ok"))


@query("s10_claims_upsert", f"""with {_NORM}, stored as (select claim_id, amount_paise + 1 as amount_paise from norm where k % 2 = 0)
    select claim_id, amount_paise, 'stored' as origin from stored union all select claim_id, amount_paise, 'new' from norm where claim_id not in (select claim_id from stored)""")
def s10(spark, d):
    n = normalised(spark, d).select("claim_id", "amount_paise", F.col("record.event_id").alias("eid"))
    p = B.presentations(spark, d).select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("eid"), "k")
    stored = n.join(p, "eid").filter(F.col("k") % 2 == 0).select("claim_id", (F.col("amount_paise") + 1).alias("amount_paise"))
    fresh = n.join(stored.select("claim_id"), "claim_id", "left_anti")
    return stored.withColumn("origin", F.lit("stored")).unionByName(fresh.select("claim_id", "amount_paise", F.lit("new").alias("origin")))


@query("s11_persist", f"""with {_NORM}
    select 'claims' as target, count(*) as n, cast(sum(amount_paise) as bigint) as paise from norm union all select 'records', count(*), 0 from norm
    union all select 'archive_links', count(*), 0 from norm union all select 'ledger', count(*), cast(sum(ltv_remaining_paise) as bigint) from norm""")
def s11(spark, d):
    n = normalised(spark, d)
    ledger = n.select("claim_id", "subject_token", F.lit("claim_detected").alias("event_type"), F.to_json(F.struct("amount_paise", "ltv_remaining_paise", "claim_type", "rail")).alias("body"), "ltv_remaining_paise")
    outs = [("claims", n.drop("record"), F.sum("amount_paise")), ("records", n.select("subject_token", "record"), F.lit(0)),
            ("archive_links", n.select("archive_id", "subject_token"), F.lit(0)), ("ledger", ledger, F.sum("ltv_remaining_paise"))]
    res = None
    for name, df, total in outs:
        path = scratch_path(spark, f"persist-{name}")
        df.write.mode("append").parquet(path)
        one = spark.read.schema(df.schema).parquet(path).agg(F.count(F.lit(1)).alias("n"), total.cast("long").alias("paise")).select(F.lit(name).alias("target"), "n", "paise")
        res = one if res is None else res.unionByName(one)
    return res


# ---- strata and arms ---------------------------------------------------------------------------------
def portfolio_totals(spark, d) -> DataFrame:
    c = B.claims(spark, d).withColumn("position", F.col("claim_no"))
    return ingest.subject_totals(c)


_TOTALS = """tot as (select subject_token, count(*) as claim_count, cast(sum(amount_paise) as bigint) as total_paise, arg_max(rail, (amount_paise, -claim_no)) as rail from claims group by 1)"""
_CUTS = """ranked as (select total_paise, row_number() over (order by total_paise) - 1 as pos, count(*) over () as n from tot),
    cuts as (select i, total_paise as cut from ranked, (select unnest(range(1, 10)) as i) where pos = least(n - 1, i * n // 10))"""
_STRATA = f"""{_TOTALS}, {_CUTS}, strata as (select t.*, case when claim_count = 1 then '1' when claim_count <= 3 then '2_3' else '4_plus' end as claim_bucket,
      least((select count(*) from cuts where cut <= t.total_paise), 9) as value_decile from tot t),
    keyed as (select *, claim_bucket || '|' || value_decile || '|' || rail as stratum from strata),
    drawn as (select *, cast(cast('0x' || substr(sha256('exp-1' || chr(31) || stratum || chr(31) || subject_token), 1, 16) as ubigint) as double) / 18446744073709551616.0 as draw from keyed),
    armed as (select *, case when draw < 0.2 then 'null' when draw < 0.4 then 'naive_dunning' when draw < 0.6000000000000001 then 'gateway_default' when draw < 0.8 then 'greedy_unconstrained' else 'priced' end as computed from drawn)"""


@query("a05_subject_totals", f"with {_TOTALS} select * from tot")
def a05(spark, d):
    return portfolio_totals(spark, d)


@query("w12_decile_cutoffs", f"with {_TOTALS}, {_CUTS} select cast(i as bigint) as i, cut from cuts")
def w12(spark, d):
    return ingest.decile_positions(portfolio_totals(spark, d), "total_paise").select(F.col("i").cast("long").alias("i"), F.col("total_paise").alias("cut"))


@query("n05_strata", f"with {_STRATA} select subject_token, claim_bucket, cast(value_decile as bigint) as value_decile, stratum from keyed")
def n05(spark, d):
    t = portfolio_totals(spark, d)
    a = ingest.assign_arms(t, ingest.decile_cutoffs(t), B.EXPERIMENT, dims.ARMS)
    return a.select("subject_token", "claim_bucket", F.col("value_decile").cast("long").alias("value_decile"), "stratum")


@query("m23_batch_arms", f"with {_STRATA} select computed as arm, stratum, count(*) as subjects, cast(sum(total_paise) as bigint) as total_paise from armed group by 1, 2")
def m23(spark, d):
    return armed(spark, d).groupBy("arm", "stratum").agg(F.count(F.lit(1)).alias("subjects"), F.sum("total_paise").alias("total_paise"))


def armed(spark, d) -> DataFrame:
    t = portfolio_totals(spark, d)
    return ingest.assign_arms(t, ingest.decile_cutoffs(t), B.EXPERIMENT, dims.ARMS)


@query("j01_stored_arm_wins", f"with {_STRATA} select subject_token, case when claim_count > 12 then 'priced' else computed end as arm, claim_count <= 12 as newly_assigned from armed")
def j01(spark, d):
    t = portfolio_totals(spark, d)
    stored = t.filter(F.col("claim_count") > 12).select("subject_token", F.lit("priced").alias("arm"))
    return ingest.assign_arms(t, ingest.decile_cutoffs(t), B.EXPERIMENT, dims.ARMS, stored).select("subject_token", "arm", "newly_assigned")


@query("j24_accounts_of_subject", "select 'cust_' || (user_id // 2) as customer_ref, count(distinct account_ref) as accounts, count(*) as n from presentations group by 1")
def j24(spark, d):
    p = B.presentations(spark, d).withColumn("customer_ref", F.concat(F.lit("cust_"), F.floor(F.col("user_id") / 2).cast("string")))
    per = p.groupBy("customer_ref", "account_ref").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("customer_ref").agg(F.count(F.lit(1)).alias("accounts"), F.sum("c").alias("n"))


@query("u07_distinct_subjects", "select count(distinct subject_token) as subjects, count(distinct rail || claim_type) as kinds from claims")
def u07(spark, d):
    c = B.claims(spark, d)
    both = c.select(F.inline(F.array(F.struct(F.lit("s").alias("what"), F.col("subject_token").alias("v")),
                                     F.struct(F.lit("k").alias("what"), F.concat("rail", "claim_type").alias("v"))))).distinct()
    return both.agg(F.count_if(F.col("what") == "s").alias("subjects"), F.count_if(F.col("what") == "k").alias("kinds"))


@query("w15_next_record_seq", """
    with ex as (select subject_token, count(*) as top from claims where state = 'planned' group by 1)
    select claim_no, coalesce(top, 0) + row_number() over (partition by subject_token order by detected_at, claim_no) as record_seq from claims left join ex using (subject_token) where state <> 'planned'""")
def w15(spark, d):
    c = B.claims(spark, d)
    existing = c.filter(F.col("state") == "planned").groupBy("subject_token").agg(F.count(F.lit(1)).alias("record_seq"))
    inc = c.filter(F.col("state") != "planned").select("subject_token", "claim_no", "detected_at")
    return ingest.next_record_seq(existing, inc, ["detected_at", "claim_no"], F.to_date("detected_at")).select("claim_no", "record_seq")
