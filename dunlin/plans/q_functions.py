"""Scalar functions of the domain, each run over a whole given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, money, stats, text, times
from dunlin.plans.registry import query
from dunlin.plans.sqlbridge import AT
from dunlin.session import table
from dunlin.sources import bridge as B

_NS = hashing.CLAIM_SPACE.replace("-", "")


def _uuid_sql(space: str, expr: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({expr}))"
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
            f"lower(printf('%02x', (cast(('0x'||substr({h},17,2)) as bigint) & 63) | 128))||substr({h},19,2)||'-'||substr({h},21,12)")


def _hmac_sql(key: bytes, blob: str) -> str:
    block = key.ljust(64, b"\0")
    i, o = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || {blob})))"


# ---- hash and identity -----------------------------------------------------------------------
@query("h01_subject_token", f"""
    select c_custkey, 'sub_' || substr({_hmac_sql(B.PEPPER, "encode(lower(trim('  ' || c_name || ' ')))")}, 1, 32) as subject_token
    from customer""")
def h01(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", hashing.subject_token(F.concat(F.lit("  "), "c_name", F.lit(" ")), B.PEPPER).alias("subject_token"))


@query("h02_claim_id", f"""
    select event_id, {_uuid_sql(hashing.CLAIM_SPACE, "source || chr(31) || event_id")} as claim_id from presentations""")
def h02(spark, d):
    return B.presentations(spark, d).select("event_id", hashing.claim_id(F.col("source"), F.col("event_id").cast("string")).alias("claim_id"))


@query("h03_mandate_ref", "select user_id, count(*) as n, 'mnd_' || substr(sha256('UMRN' || user_id), 1, 32) as mandate_ref from events group by user_id")
def h03(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("mandate_ref", hashing.mandate_ref(F.concat(F.lit("UMRN"), F.col("user_id").cast("string"))))


@query("h04_payload_hash", "select event_id, sha256(props) as payload_hash from events")
def h04(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2("props", 256).alias("payload_hash"))


@query("h07_arm_draw", f"""
    with t as (select {B and "'sub_' || substr(sha256(cast(c_custkey as varchar)), 1, 32)"} as subject_token, 's' || (c_custkey % 4) as stratum from customer),
    d as (select subject_token, cast(cast('0x' || substr(sha256('exp-1' || chr(31) || stratum || chr(31) || subject_token), 1, 16) as ubigint) as double) / 18446744073709551616.0 as draw from t)
    select subject_token, round(draw, 9) as draw, case when draw < 0.2 then 'null' when draw < 0.4 then 'naive_dunning' when draw < 0.6000000000000001 then 'gateway_default'
      when draw < 0.8 then 'greedy_unconstrained' else 'priced' end as arm from d""")
def h07(spark, d):
    c = table(spark, d, "customer").select(B.token_of(F.col("c_custkey")).alias("subject_token"),
                                           F.concat(F.lit("s"), (F.col("c_custkey") % 4).cast("string")).alias("stratum"))
    draw = hashing.arm_draw(B.EXPERIMENT, F.col("stratum"), F.col("subject_token"))
    return c.select("subject_token", F.round(draw, 9).alias("draw"), hashing.pick_by_share(draw, dims.ARMS).alias("arm"))


@query("h08_category_bucket", """
    with recursive v as (select distinct p_brand || '|' || p_type as v from part),
    pw as (select i, ((31::hugeint ** 0)::hugeint) as dummy from range(0, 1) r(i)),
    powers as (select 0 as i, cast(1 as bigint) as p union all select i + 1, p * 31 % 1000003 from powers where i < 63),
    b as (select v, i, cast('0x' || substr(hex(encode(v)), cast(i * 2 + 1 as bigint), 2) as bigint) as byte, p
          from v join powers on i < octet_length(encode(v)))
    select v as category, cast(sum(byte * p) % 64 as double) as bucket, (select count(*) from part where p_brand || '|' || p_type = b.v) as parts
    from b group by v""")
def h08(spark, d):
    p = table(spark, d, "part").groupBy(F.concat("p_brand", F.lit("|"), "p_type").alias("category")).agg(F.count(F.lit(1)).alias("parts"))
    return p.select("category", hashing.category_bucket(F.col("category")).alias("bucket"), "parts")


@query("h09_canonical_json", """
    select event_id, '{"amount_paise":' || amount_paise || ',"event_type":"' || event_type || '","seq":' || event_id || ',"subject":"' || account_ref || '"}' as body
    from presentations""")
def h09(spark, d):
    p = B.presentations(spark, d)
    body = F.to_json(F.struct(F.col("amount_paise"), F.col("event_type"), F.col("event_id").alias("seq"), F.col("account_ref").alias("subject")))
    return p.select("event_id", body.alias("body"))


@query("h10_fingerprint", "select doc_id, substr(sha256(text), 1, 8) as fp8, substr(sha256(text), 1, 32) as fp32 from documents")
def h10(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.fingerprint(F.col("text")).alias("fp8"), hashing.fingerprint(F.col("text"), 32).alias("fp32"))


# ---- date and time -------------------------------------------------------------------------------
@query("d01_parse_instants", """
    select event_id, cast(floor(epoch_us(ts) / 1000000) as bigint) * 1000000 as from_epoch_us, epoch_us(ts) as from_iso_us,
      epoch_us(ts) - 19800000000 as from_offset_us from events""")
def d01(spark, d):
    e = table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", F.unix_micros(times.epoch_to_ts(F.unix_seconds("ts").cast("string"))).alias("from_epoch_us"),
                    F.unix_micros(times.iso_to_ts(iso)).alias("from_iso_us"),
                    F.unix_micros(times.iso_to_ts(F.concat(iso, F.lit("+05:30")))).alias("from_offset_us"))


@query("d02_local_time", """
    select l.event_id, strftime(timezone(z.zone, l.ts at time zone 'UTC'), '%Y-%m-%d %H:%M:%S') as local_text
    from events l join (select 0 as i, 'Asia/Kolkata' as zone union all select 1, 'Asia/Dubai' union all select 2, 'America/New_York') z on l.user_id % 3 = z.i""")
def d02(spark, d):
    e = table(spark, d, "events")
    zone = F.get(F.array(*map(F.lit, B.ZONES)), (F.col("user_id") % 3).cast("int"))
    return e.select("event_id", F.date_format(times.local(F.col("ts"), zone), "yyyy-MM-dd HH:mm:ss").alias("local_text"))


@query("d03_buckets", "select event_id, " + ", ".join(f"cast(floor(epoch_us(ts) / 1000000 / {s}) as bigint) as b_{n}" for n, s, _ in dims.LADDER) + " from events")
def d03(spark, d):
    return table(spark, d, "events").select("event_id", *[times.bucket(F.col("ts"), s).alias(f"b_{n}") for n, s, _ in dims.LADDER])


@query("d04_rolling_window", f"""
    select user_id, count(*) filter (where ts >= {AT} - interval 7 day and ts < {AT}) as n_7d,
      count(*) filter (where ts >= {AT} - interval 1 day and ts < {AT}) as n_1d from events group by user_id""")
def d04(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(times.in_window(F.col("ts"), B.at_lit(), 7 * 86400)).alias("n_7d"),
                                    F.count_if(times.in_window(F.col("ts"), B.at_lit(), 86400)).alias("n_1d"))


@query("d05_next_contact_window", """
    with l as (select event_id, ts, timezone('Asia/Kolkata', ts at time zone 'UTC') as loc from events),
    m as (select *, hour(loc) * 60 + minute(loc) as mi from l)
    select event_id, case when mi >= 480 and mi < 1140 then epoch_us(ts)
      else epoch_us(timezone('Asia/Kolkata', date_trunc('day', loc) + case when mi < 480 then interval 8 hour else interval 32 hour end)) end as next_us
    from m""")
def d05(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_micros(times.next_contact_window(F.col("ts"), F.lit("Asia/Kolkata"))).alias("next_us"))


@query("d06_days_to_day_of_month", """
    select event_id, case when (user_id % 28 + 1) - day(ts) >= 0 then (user_id % 28 + 1) - day(ts) else (user_id % 28 + 1) - day(ts) + 30 end as ahead from events""")
def d06(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", times.days_to_day_of_month(F.dayofmonth("ts").cast("long"), F.col("user_id") % 28 + 1).alias("ahead"))


@query("d07_since", f"""
    select event_id, round((epoch_us({AT}) - epoch_us(ts)) / 1000000.0 / 86400.0, 6) as days_since, round((epoch_us({AT}) - epoch_us(ts)) / 1000000.0 / 3600.0, 6) as hours_since,
      day(ts) >= 26 as month_end from events""")
def d07(spark, d):
    s = times.seconds_between(B.at_lit(), F.col("ts"))
    return table(spark, d, "events").select("event_id", F.round(s / 86400.0, 6).alias("days_since"), F.round(s / 3600.0, 6).alias("hours_since"),
                                            (F.dayofmonth("ts") >= 26).alias("month_end"))


_PROMISE_SQL = f"""
    pr as (select o_orderkey as claim_no, o_orderdate as made_at, o_orderdate + to_hours(12 * (o_orderkey % 60)) as due_at from orders),
    kp as (select l_orderkey as claim_no, min(l_shipdate) as first_paid from lineitem group by l_orderkey),
    pk as (select pr.*, timestamp '2001-07-01' as observed_until, case when first_paid <= due_at + interval 24 hour then first_paid end as kept_at
           from pr left join kp using (claim_no)),
    ph as (select *, greatest(cast(round_even((epoch_us(due_at) - epoch_us(made_at)) / 1000000.0 / 86400.0, 0) as bigint), 1) as horizon_days,
             due_at + interval 24 hour as deadline from pk),
    pc as (select *, kept_at is null and observed_until < deadline as censored from ph),
    po as (select *, greatest(least(cast(floor((epoch_us(least(observed_until, deadline)) - epoch_us(made_at)) / 86400000000.0) as bigint), horizon_days),
             case when censored then 0 else 1 end) as observed_days from pc)"""


def promise_table(spark, d) -> DataFrame:
    """Promises with kept instant, horizon, deadline, censoring and observed days."""
    o = table(spark, d, "orders")
    pr = o.select(F.col("o_orderkey").alias("claim_no"), F.col("o_orderdate").alias("made_at"),
                  times.add_seconds(F.col("o_orderdate"), (F.col("o_orderkey") % 60) * 43200.0).alias("due_at"))
    kp = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_no")).agg(F.min("l_shipdate").alias("first_paid"))
    j = pr.join(kp, "claim_no", "left").withColumn("observed_until", F.lit("2001-07-01").cast("timestamp"))
    j = j.withColumn("deadline", times.promise_deadline(F.col("due_at"), 24))
    j = j.withColumn("kept_at", F.when(F.col("first_paid") <= F.col("deadline"), F.col("first_paid")))
    j = j.withColumn("horizon_days", times.promise_horizon_days(F.col("made_at"), F.col("due_at")))
    j = j.withColumn("censored", F.col("kept_at").isNull() & (F.col("observed_until") < F.col("deadline")))
    return j.withColumn("observed_days", times.promise_observed_days(F.col("made_at"), F.col("horizon_days"), F.col("deadline"),
                                                                     F.col("observed_until"), F.col("censored")))


@query("d08_promise_clock", f"with {_PROMISE_SQL} select claim_no, horizon_days, epoch_us(deadline) as deadline_us, censored, observed_days, kept_at is not null as kept from po")
def d08(spark, d):
    return promise_table(spark, d).select("claim_no", "horizon_days", F.unix_micros("deadline").alias("deadline_us"), "censored", "observed_days",
                                          F.col("kept_at").isNotNull().alias("kept"))


@query("d09_stale_families", f"""
    with seen as (select user_id, max(ts) filter (where event_type = 'view' and ts < {AT}) as issuer_health, max(ts) filter (where event_type = 'click' and ts < {AT}) as contact_history,
      max(ts) filter (where event_type = 'purchase' and ts < {AT}) as payment_history, max(ts) filter (where event_type = 'signup' and ts < {AT}) as account_attributes from events group by user_id)
    select user_id, concat_ws(',', {", ".join(f"case when {f} is null or epoch_us({AT}) - epoch_us({f}) >= {t * 1000000} then '{f}' end" for f, t in dims.FRESHNESS_TTL)}) as stale from seen""")
def d09(spark, d):
    kinds = dict(zip([f for f, _ in dims.FRESHNESS_TTL], ["view", "click", "purchase", "signup"]))
    e = table(spark, d, "events").groupBy("user_id").agg(
        *[F.max(F.when((F.col("event_type") == k) & (F.col("ts") < B.at_lit()), F.col("ts"))).alias(f) for f, k in kinds.items()])
    return e.select("user_id", F.array_join(stale_families(B.at_lit()), ",").alias("stale"))


def stale_families(at):
    """Feature families whose age has reached their time to live, or that were never observed."""
    return F.filter(F.array(*[F.when(F.col(f).isNull() | (times.seconds_between(at, F.col(f)) >= t), F.lit(f)) for f, t in dims.FRESHNESS_TTL]),
                    lambda x: x.isNotNull())


@query("d10_backoff", "select status, attempts, least(cast(2 ** greatest(attempts, 1) as bigint), 900) as wait_s, count(*) as n from outbox group by all")
def d10(spark, d):
    return B.outbox(spark, d).groupBy("status", "attempts", times.backoff_seconds(F.col("attempts")).alias("wait_s")).agg(F.count(F.lit(1)).alias("n"))


@query("d11_reservation_tier", f"select case when epoch_us(not_before) - epoch_us({AT}) <= 900000000 then 'hard' else 'soft' end as tier, count(*) as n from outbox group by 1")
def d11(spark, d):
    return B.outbox(spark, d).groupBy(times.reservation_tier(times.seconds_between(F.col("not_before"), B.at_lit())).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


# ---- math ------------------------------------------------------------------------------------
@query("n01_safe_ratio", "select l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_discount * 100, 0), -1), 7) as ratio, count(*) as n from lineitem group by all")
def n01(spark, d):
    li = table(spark, d, "lineitem")
    r = F.round(F.coalesce(stats.ratio(F.col("l_extendedprice"), F.col("l_discount") * 100), F.lit(-1.0)), 7)
    return li.groupBy("l_orderkey", "l_linenumber", r.alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


@query("n02_bounce_streak", "select account_ref, greatest(count(*) filter (where not succeeded) - count(*) filter (where succeeded), 0) as streak from presentations group by 1")
def n02(spark, d):
    p = B.presentations(spark, d).groupBy("account_ref").agg(F.count_if(~F.col("succeeded")).alias("f"), F.count_if("succeeded").alias("s"))
    return p.select("account_ref", F.greatest(F.col("f") - F.col("s"), F.lit(0)).alias("streak"))


@query("n03_inverse_weight", "select event_id, round(case when value is null then 1.0 when value / 100 <= 0.0001 then 20.0 else least(1.0 / (value / 100), 20.0) end, 6) as w from events")
def n03(spark, d):
    p = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.round(stats.inverse_weight(F.when(p <= 0.0001, F.lit(0.0)).otherwise(p)), 6).alias("w"))


@query("n04_half_widths", """
    with g as (select user_id, count(*) as n, avg(case when event_type = 'error' then 1.0 else 0.0 end) as p, count(*) filter (where event_type = 'click') as t, count(*) filter (where event_type = 'view') as c from events group by 1)
    select user_id, round(case when n <= 0 then 0.5 else greatest(2 * sqrt(greatest(p * (1 - p), 1e-6) / n), 0.01) end, 6) as binomial, round(greatest(1 / sqrt(greatest(least(t, c), 1)), 0.01), 6) as effect from g""")
def n04(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("p"),
        F.count_if(F.col("event_type") == "click").alias("t"), F.count_if(F.col("event_type") == "view").alias("c"))
    return g.select("user_id", F.round(stats.binomial_half_width(F.col("p"), F.col("n")), 6).alias("binomial"),
                    F.round(stats.effect_half_width(F.col("t"), F.col("c")), 6).alias("effect"))


@query("n06_format_inr", """
    with a as (select c_custkey, cast(round(c_acctbal * 100) as bigint) * (c_custkey % 1000 + 1) as p from customer),
    w as (select *, cast(abs(p) // 100 as varchar) as t from a)
    select c_custkey, case when p < 0 then '-' else '' end || '₹' || case when length(t) <= 3 then t else
      reverse(regexp_replace(regexp_replace(reverse(substr(t, 1, length(t) - 3)), '(\\d\\d)', '\\1,', 'g'), ',$', '')) || ',' || right(t, 3) end
      || '.' || lpad(cast(abs(p) % 100 as varchar), 2, '0') as inr from w""")
def n06(spark, d):
    p = money.paise_from_double(F.col("c_acctbal")) * (F.col("c_custkey") % 1000 + 1)
    return table(spark, d, "customer").select("c_custkey", money.format_inr(p).alias("inr"))


@query("n07_ramp_cap", """
    with m as (select user_id, count(*) as n from events group by 1)
    select user_id, """ + ", ".join(f"cast(floor(n * cast({r} as double)) as bigint) as step_{i}" for i, r in enumerate(dims.RAMP)) + " from m")
def n07(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ramp = F.array(*map(F.lit, dims.RAMP))
    return m.select("user_id", *[F.floor(F.col("n") * F.element_at(ramp, i + 1)).cast("long").alias(f"step_{i}") for i in range(4)])


@query("n08_within_cap", f"select instrument_ref, count(*) as used, count(*) + 1 <= 15 as within_cap from retries where at_ts >= {AT} - interval 30 day and at_ts < {AT} group by 1")
def n08(spark, d):
    r = B.retries(spark, d).filter(times.in_window(F.col("at_ts"), B.at_lit(), 30 * 86400))
    return r.groupBy("instrument_ref").agg(F.count(F.lit(1)).alias("used")).withColumn("within_cap", F.col("used") + 1 <= 15)


@query("n09_luhn", """
    with recursive c as (select c_custkey, lpad(cast(c_custkey * 7919 + 4000000000 as varchar), 16, '4') as digits from customer),
    p as (select c_custkey, digits, i, cast(substr(reverse(digits), cast(i + 1 as bigint), 1) as int) as v from c, range(0, 16) r(i))
    select c_custkey, sum(case when i % 2 = 0 then v when v * 2 > 9 then v * 2 - 9 else v * 2 end) % 10 = 0 as ok from p group by 1""")
def n09(spark, d):
    digits = F.lpad((F.col("c_custkey") * 7919 + 4000000000).cast("string"), 16, "4")
    return table(spark, d, "customer").select("c_custkey", text.luhn_ok(digits).alias("ok"))


@query("x09_rupee_text", """
    with t as (select p_partkey, cast(cast(p_retailprice as decimal(12, 2)) as varchar) as a, cast(cast(floor(p_retailprice) as bigint) as varchar) as b from part)
    select p_partkey, cast(cast(a as decimal(12, 2)) * 100 as bigint) as two_places, cast(b as bigint) * 100 as whole, true as bad_is_null from t""")
def x09(spark, d):
    p = table(spark, d, "part")
    a, b = F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.floor("p_retailprice").cast("string")
    return p.select("p_partkey", money.paise_from_text(a).alias("two_places"), money.paise_from_text(b).alias("whole"),
                    money.paise_from_text(F.concat(F.lit("Rs "), a)).isNull().alias("bad_is_null"))
