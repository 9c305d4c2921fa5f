"""Domain tables as views over the given tables.

Each function is a projection (plus at most one join) with explicit column types, so filters and
column pruning reach the parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, times
from dunlin.functions.money import paise_from_double
from dunlin.session import spread, table

# The instant at which the portfolio is decided, and the shift (days) that puts order and shipping
# dates on the same time line as the events.
AT = "2024-01-24 06:30:00"
SHIFT_DAYS = 9444
PEPPER = b"dunlin-pepper-0123456789"
EXPERIMENT = "exp-1"
ZONES = ["Asia/Kolkata", "Asia/Dubai", "America/New_York"]


def at_lit() -> Column:
    return F.lit(AT).cast("timestamp")


def _shift(c: Column) -> Column:
    return c + F.expr(f"interval {SHIFT_DAYS} days")


def token_of(key: Column) -> Column:
    return F.concat(F.lit("sub_"), F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 32))


def presentations(spark: SparkSession, d: str) -> DataFrame:
    """Every event is one attempt to debit an instrument."""
    e = table(spark, d, "events")
    outage = ((F.col("user_id") % 5 == 2) & (F.col("ts") >= F.lit("2024-01-17").cast("timestamp"))
              & (F.col("ts") < F.lit("2024-01-18").cast("timestamp")) & (F.col("event_type") != "purchase"))
    rail_no = F.floor(F.col("user_id") / 5).cast("long") % 3
    rail = F.when(rail_no == 0, "card").when(rail_no == 1, "enach").otherwise("upi_autopay")
    source = F.when(rail_no == 0, "pgw").when(rail_no == 1, "npci_nach").otherwise("upi_autopay")
    return e.select(
        "event_id", F.col("ts").alias("at_ts"), "user_id",
        F.concat(F.lit("acct_"), F.col("user_id").cast("string")).alias("account_ref"),
        F.concat(F.lit("ISS_"), (F.col("user_id") % 5).cast("string")).alias("issuer_ref"),
        rail.alias("rail"), source.alias("source"), "event_type",
        paise_from_double(F.col("value")).alias("amount_paise"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (~((F.col("event_type") == "error") | outage)).alias("succeeded"))


def decline_code() -> Column:
    """A wire code of the right rail for a failed presentation, from its own number."""
    k, rail = F.col("k"), F.col("rail")
    return (F.when(F.col("succeeded"), None)
            .when((rail == "card"), F.get(F.array(*map(F.lit, ["51", "54", "41", "05", "61", "91", "57", "XX"])), k % 8))
            .when((rail == "enach"), F.get(F.array(*map(F.lit, ["AM04", "AC01", "MD06", "MD01", "AG01", "MS03", "FF01"])), k % 7))
            .otherwise(F.get(F.array(*map(F.lit, ["Z9", "ZM", "U69", "91", "U30"])), k % 5)))


def advice_code() -> Column:
    return F.when(~F.col("succeeded") & (F.col("k") % 23 == 0), "MAC03").when(
        ~F.col("succeeded") & (F.col("k") % 23 == 1), "MAC21")


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed presentations, each one a claim detected at its own instant, with mandate facts."""
    p = presentations(spark, d).filter(~F.col("succeeded"))
    k = F.col("k")
    return p.select(
        "event_id", "at_ts", "user_id", "account_ref", "issuer_ref", "rail", "amount_paise", "k",
        decline_code().alias("decline_code"), advice_code().alias("advice_code"),
        F.when(k % 19 == 0, "checkout_abandon").when(k % 19 == 1, "invoice_overdue")
        .when(F.col("rail") == "card", "card_decline").otherwise("mandate_failure").alias("claim_type"),
        mandate_ref_of().alias("mandate_ref"),
        F.when(k % 9 == 0, F.lit(2000)).otherwise(F.lit(100000)).cast("long").alias("cap_paise"),
        F.when(k % 29 == 0, F.lit("2024-01-10").cast("timestamp")).alias("expires_at"),
        F.lit("2023-06-01").cast("timestamp").alias("registered_at"),
        F.when(F.col("user_id") % 4 == 0, F.lit("2024-01-20").cast("timestamp")).alias("instrument_reissued_at"),
        (k % 11 == 0).alias("predebit_required"),
        F.when(k % 2 == 0, times.add_seconds(F.col("at_ts"), -86400.0 * 2)).alias("predebit_notice_at"),
        F.when(k % 31 == 0, (k % 28 + 1)).cast("int").alias("scheduled_debit_day"))


def mandate_ref_of() -> Column:
    return F.concat(F.lit("mnd_"), F.substring(F.sha2(F.col("user_id").cast("string").cast("binary"), 256), 1, 32))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a claim; its status is the claim's state."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    amount = paise_from_double(F.col("o_totalprice"))
    return o.select(
        F.concat(F.lit("clm-"), F.lpad(k.cast("string"), 12, "0")).alias("claim_id"), k.alias("claim_no"),
        F.col("o_custkey").alias("cust"), token_of(F.col("o_custkey")).alias("subject_token"),
        amount.alias("amount_paise"), (amount * 12).alias("ltv_remaining_paise"),
        F.get(F.array(*map(F.lit, ["card", "enach", "upi_autopay", "invoice"])), (k % 4).cast("int")).alias("rail"),
        F.when(k % 4 == 0, "card_decline").when(k % 4 == 3, "invoice_overdue").otherwise("mandate_failure").alias("claim_type"),
        _shift(F.col("o_orderdate")).alias("detected_at"),
        F.when(F.col("o_orderstatus") == "F", "in_treatment").when(F.col("o_orderstatus") == "O", "planned")
        .otherwise("promised").alias("state"),
        F.col("o_orderpriority").alias("priority_text"))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    """Customers with consent, opt-outs, quiet hours, zone and flags."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")

    def state(i: int) -> Column:
        return (F.when((k * 7 + i) % 5 == 0, "withdrawn").when((k + i) % 11 == 0, "never_given").otherwise("granted"))
    consent = F.map_from_arrays(F.array(*map(F.lit, ["voice", "whatsapp", "sms", "email"])),
                                F.array(*[state(i) for i in range(4)]))
    at = at_lit()
    return c.select(
        k.alias("cust"), token_of(k).alias("subject_token"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"), paise_from_double(F.col("c_acctbal")).alias("balance_paise"),
        consent.alias("consent"),
        F.when(k % 17 == 0, F.array(F.lit("sms"))).when(k % 19 == 0, F.array(F.lit("voice"), F.lit("email")))
        .otherwise(F.array().cast("array<string>")).alias("opted_out"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(
            F.get(F.array(*map(F.lit, ZONES)), F.when(k % 6 == 0, 1).when(k % 6 == 1, 2).otherwise(0))).alias("tz_zone"),
        F.when(k % 13 == 0, 1260).when(k % 13 == 1, 690).cast("int").alias("quiet_start_min"),
        F.when(k % 13 == 0, 420).when(k % 13 == 1, 780).cast("int").alias("quiet_end_min"),
        F.when(F.col("c_nationkey") % 5 == 0, F.array(F.lit("2024-01-24").cast("date"), F.lit("2024-01-26").cast("date")))
        .otherwise(F.array(F.lit("2024-01-26").cast("date"))).alias("bank_holidays"),
        F.when(k % 29 == 0, "guarantor").when(k % 31 == 0, "third_party").when(k % 37 == 0, "employer")
        .when(k % 41 == 0, "unknown").otherwise("obligor").alias("target"),
        F.struct(
            (k % 43 == 0).alias("forborne"), (k % 47 == 0).alias("minor"), (k % 53 == 0).alias("erasure_requested"),
            (k % 59 == 0).alias("hardship"), (k % 61 == 0).alias("complaint_open"), (k % 67 == 0).alias("disputed"),
            (k % 3 != 0).alias("identity_verified"),
            (k % 21 == 0).alias("ptp_active"),
            F.when(k % 2 == 0, times.add_seconds(at, -36000.0)).otherwise(times.add_seconds(at, 172800.0)).alias("ptp_freeze_until"),
            (k % 33 == 0).alias("payment_pending"),
            F.when(k % 2 == 1, times.add_seconds(at, 7200.0)).alias("payment_pending_until"),
            (k % 71 == 0).alias("issuer_degraded"), times.add_seconds(at, -3600.0).alias("issuer_degraded_until")
        ).alias("flags"))


def contacts(spark: SparkSession, d: str, since_hours: float | None = None) -> DataFrame:
    """Shipped lines as outbound contacts with the customer of the order.

    ``since_hours`` keeps the contacts from so long before the decision moment up to a quarter hour
    after it, as a filter on the stored date.
    """
    li = table(spark, d, "lineitem")
    if since_hours is not None:
        base = datetime.fromisoformat(AT) - timedelta(days=SHIFT_DAYS)
        lo, hi = base - timedelta(hours=since_hours), base + timedelta(minutes=15)
        li = li.filter((F.col("l_shipdate") >= F.lit(str(lo)).cast("timestamp")) & (F.col("l_shipdate") < F.lit(str(hi)).cast("timestamp")))
    o = table(spark, d, "orders")
    ch = F.get(F.array(*map(F.lit, ["voice", "whatsapp", "sms", "email"])), F.col("l_linenumber") % 4)
    out = F.when(F.col("l_returnflag") == "R", "no_answer").when(F.col("l_returnflag") == "A", "connected").otherwise("delivered")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("claim_no"), token_of(F.col("o_custkey")).alias("subject_token"),
        _shift(F.col("l_shipdate")).alias("at_ts"), ch.alias("channel"), out.alias("outcome"),
        F.col("l_linenumber").cast("long").alias("line_no"))
    return joined


def retries(spark: SparkSession, d: str) -> DataFrame:
    """Every presentation counts against the network budget of its holder."""
    p = presentations(spark, d)
    return p.select(F.col("user_id").alias("cust"), token_of(F.col("user_id")).alias("subject_token"),
                    F.concat(F.lit("ins_"), F.col("user_id").cast("string")).alias("instrument_ref"),
                    F.concat(F.lit("att_"), F.col("event_id").cast("string")).alias("attempt_ref"),
                    "at_ts", "rail", F.when(F.col("event_id") % 3 == 0, "gateway").otherwise("platform").alias("initiated_by"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Logged decisions with outcome, one row per event: five actions with published shares.

    The branch probabilities of a row are the shares; part of each branch's mass is vetoed, by a rule
    that depends on the subject, and lands on do_nothing.
    """
    p = presentations(spark, d)
    action = (F.when(F.col("event_type") == "view", "do_nothing").when(F.col("event_type") == "click", "sms")
              .when(F.col("event_type") == "signup", "voice_call").when(F.col("event_type") == "purchase", "retry")
              .otherwise("email"))
    return p.select(
        F.col("event_id").alias("row_no"), token_of(F.col("user_id")).alias("subject_token"), F.col("user_id").alias("cust"),
        (F.dayofmonth("at_ts") % 4).alias("cycle"), "at_ts",
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("stratum"), action.alias("action"),
        F.when((F.col("k") % 2 == 0) | F.col("succeeded"), F.col("amount_paise")).otherwise(F.lit(0)).cast("long").alias("reward_paise"),
        (F.col("k") % 7 == 0).alias("adverse"), (F.col("k") % 13 == 0).alias("opted_out"),
        (F.col("k") % 17 == 0).alias("complained"), (F.col("k") % 5 == 0).alias("promised"),
        F.col("succeeded").alias("paid"), "k", "issuer_ref", "rail", "amount_paise")


# fixed values: logging shares of the five logged actions
SHARES = {"do_nothing": 0.3, "sms": 0.25, "voice_call": 0.15, "retry": 0.2, "email": 0.1}


def promises(spark: SparkSession, d: str) -> DataFrame:
    """A promise per order, due a week later, kept when the first shipment came by then."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_no"), token_of(F.col("o_custkey")).alias("subject_token"),
        F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("made_at"),
        (F.col("o_orderdate") + F.expr("interval 7 days")).alias("due_at"),
        paise_from_double(F.col("o_totalprice")).alias("amount_paise"))


def payments(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("claim_no"), F.col("l_shipdate").alias("paid_at"),
                     paise_from_double(F.col("l_extendedprice")).alias("amount_paise"),
                     F.col("l_linenumber").cast("long").alias("line_no"))


def money_entries(spark: SparkSession, d: str) -> DataFrame:
    """Two legs per movement: opening a claim from its order, recovering it line by line."""
    o = table(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("group_id"), F.col("o_orderkey").alias("claim_no"),
        F.lit("external").alias("frm"), F.lit("at_risk").alias("to"), paise_from_double(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderdate").alias("occurred_at"))
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("group_id"),
        F.col("l_orderkey").alias("claim_no"), F.lit("at_risk").alias("frm"),
        F.when(F.col("l_returnflag") == "R", "in_treatment").otherwise("recovered").alias("to"),
        paise_from_double(F.col("l_extendedprice") / 10).alias("amount"), F.col("l_shipdate").alias("occurred_at"))
    moves = o.unionByName(li)
    return moves.select("group_id", "claim_no", "occurred_at", F.inline(F.array(
        F.struct(F.col("frm").alias("account"), (-F.col("amount")).alias("delta_paise")),
        F.struct(F.col("to").alias("account"), F.col("amount").alias("delta_paise")))))


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Queue rows from order lines."""
    c = claims(spark, d)
    n = F.col("claim_no")
    act = F.get(F.array(*map(F.lit, dims.ACTION_NAMES)), (n % 13).cast("int"))
    at = at_lit()
    return c.select(
        "claim_id", "claim_no", "subject_token", "cust", "state", act.alias("action"),
        F.get(F.array(*map(F.lit, ["pending", "in_flight", "sent", "failed", "dead", "cancelled"])), (n % 6).cast("int")).alias("status"),
        F.substring("priority_text", 1, 1).cast("int").alias("priority"),
        times.add_seconds(at, ((n % 41) - 30) * 600.0).alias("not_before"),
        (n % 8).cast("int").alias("attempts"),
        times.add_seconds(at, ((n % 37) - 20) * 300.0 - 900.0).alias("cert_valid_from"),
        times.add_seconds(at, ((n % 37) - 20) * 300.0 + 900.0).alias("cert_valid_until"),
        F.concat_ws(":", F.col("claim_id"), act).alias("idempotency_key"))


SECRETS = {"pgw": b"pgw-secret-0123456789", "npci_nach": b"nach-secret-012345678", "upi_autopay": b"upi-secret-0123456789",
           "billing": b"billing-secret-012345"}


def _rec(*cols: Column) -> Column:
    """Struct whose field names are literals taken from the column aliases."""
    parts = []
    for c in cols:
        text = c._jc.toString() if hasattr(c, "_jc") else str(c)
        parts += [F.lit(text.rsplit(" AS ", 1)[-1].strip("`")), c]
    return F.named_struct(*parts)


#: Events whose bodies one task builds, signs and checks.
DELIVERY_ROWS = 200_000


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Signed wire bodies in four dialects built from the events, with planted faults.

    Some are delivered twice, some are tampered with after signing, some carry an old signature,
    some are not JSON, and some come from a source nobody knows.
    """
    p = spread(presentations(spark, d), DELIVERY_ROWS)
    k, n = F.col("k"), F.col("event_id")
    code = decline_code()
    p = p.withColumn("code", code).withColumn("advice", advice_code())
    p = p.withColumn("src", F.when(k % 47 == 3, "mystery").when((k % 19 == 1) & ~F.col("succeeded"), "billing").otherwise(F.col("source")))
    user = F.col("user_id").cast("string")
    sec = F.unix_seconds("at_ts")
    name, phone = F.concat(F.lit("Holder "), user), F.concat(F.lit("98"), F.lpad(user, 8, "0"))
    email = F.concat(F.lit("u"), user, F.lit("@example.com"))
    notes = _rec(F.col("account_ref").alias("account_id"), (k % 3).alias("attempt"),
                     F.when(k % 4 == 0, "gateway").when(k % 4 == 1, "merchant").alias("initiated_by"))
    eid = F.concat(F.lit("evt_"), n.cast("string"))
    cust = _rec(F.concat(F.lit("cust_"), user).alias("id"), name.alias("name"), email.alias("email"), phone.alias("contact"))
    entity = _rec(eid.alias("id"), F.col("amount_paise").alias("amount"), F.when(F.col("succeeded"), "captured").otherwise("failed").alias("status"),
                      _rec(F.lpad(user, 4, "0").alias("last4"), F.lit("visa").alias("network"), F.col("issuer_ref").alias("issuer")).alias("card"),
                      F.col("code").alias("error_reason"), F.lit("declined by bank").alias("error_description"),
                      F.col("advice").alias("merchant_advice_code"), cust.alias("customer"), notes.alias("notes"))
    checkout = ~F.col("succeeded") & (k % 19 == 0)
    pgw = F.to_json(_rec(
        F.when(F.col("succeeded"), "payment.captured").when(checkout, "checkout.abandoned").otherwise("payment.failed").alias("event"),
        sec.alias("created_at"), _rec(F.when(~checkout, entity).alias("payment"), F.when(checkout, entity).alias("order")).alias("payload")))
    rupees = (F.col("amount_paise") / 100).cast("decimal(18,2)").cast("string")
    nach = F.to_json(_rec(
        F.when(F.col("succeeded"), "ACH_DR_SETTLED").otherwise("ACH_DR_RETURN").alias("message_type"), F.concat(F.lit("UMRN"), user).alias("umrn"),
        eid.alias("transaction_id"), F.date_format("at_ts", "yyyy-MM-dd").alias("settlement_date"), rupees.alias("amount"),
        F.col("code").alias("return_code"), F.col("issuer_ref").alias("destination_bank"),
        _rec(name.alias("name"), F.lpad(user, 4, "0").alias("account_last4"), F.lit("ABCD0123456").alias("ifsc"), phone.alias("mobile")).alias("customer"),
        F.concat(F.lit("ACH DR RTN CHG "), user).alias("narration"), notes.alias("reference")))
    upi = F.to_json(_rec(
        F.when(F.col("succeeded"), "autopay.debit.success").otherwise("autopay.debit.failed").alias("event"), F.concat(F.lit("UMRN"), user).alias("mandate_id"),
        eid.alias("txn_id"), F.date_format("at_ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), F.col("amount_paise"),
        F.col("code").alias("npci_error_code"), F.lit("bank says no").alias("npci_error_desc"), F.col("issuer_ref").alias("issuer"),
        _rec(F.concat(F.lit("u"), user, F.lit("@upi")).alias("vpa"), name.alias("name"), phone.alias("mobile")).alias("payer"), notes.alias("ref")))
    billing = F.to_json(_rec(
        F.lit("invoice.overdue").alias("type"), sec.alias("created_at"),
        _rec(eid.alias("id"), rupees.alias("amount_due"), F.date_format("at_ts", "yyyy-MM-dd").alias("due_date"), (k % 60).alias("days_overdue"),
                 F.when(k % 60 < 30, "0-30").otherwise("31-60").alias("ageing_bucket"),
                 _rec(name.alias("name"), email.alias("email"), phone.alias("contact"), F.lit("27ABCDE1234F1Z5").alias("gstin")).alias("buyer")).alias("invoice"),
        notes.alias("ref")))
    body = (F.when(k % 43 == 2, F.lit("{broken")).when(F.col("src") == "npci_nach", nach).when(F.col("src") == "upi_autopay", upi)
            .when(F.col("src") == "billing", billing).otherwise(pgw))
    rows = p.select(n.alias("event_no"), F.col("src").alias("source"), "k", body.alias("body"), sec.alias("sec"),
                    F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    stamp = (F.col("sec") + F.col("copy") * 60 - F.when(k % 41 == 1, 3 * 86400).otherwise(0)).cast("string")
    signed = F.concat(F.col("body"), F.when(k % 37 == 0, " ").otherwise(""))
    digest = F.lit("0" * 64)
    for s, secret in SECRETS.items():
        digest = F.when(F.col("source") == s, hashing.hmac_sha256(secret, F.encode(F.concat(stamp, F.lit("."), signed), "utf-8"))).otherwise(digest)
    return rows.select((F.col("event_no") * 2 + F.col("copy")).alias("archive_id"), "source", F.encode("body", "utf-8").alias("raw"),
                       F.concat(F.lit("t="), stamp, F.lit(",v1="), digest).alias("signature"),
                       F.timestamp_seconds(F.col("sec") + F.col("copy") * 60 + 30).alias("received_at"))


def gate_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the claim-level facts the rules and the effect surface look at."""
    c, n, at = claims(spark, d), F.col("claim_no"), at_lit()
    return c.select(
        "*",
        F.when(n % 7 != 0, F.lit(40000000).cast("long")).alias("mandate_cap_paise"),
        F.when(n % 5 == 1, times.add_seconds(at, -36000.0)).when(n % 5 > 1, times.add_seconds(at, -108000.0)).alias("predebit_notice_at"),
        F.get(F.array(*map(F.lit, ["lost_or_stolen", "account_closed", "stop_payment", "do_not_honour"])), (n % 11).cast("int")).alias("_dc"),
        F.when(n % 13 == 0, "MAC03").when(n % 13 == 1, " r08 ").when(n % 13 == 2, "XX").alias("advice_code"),
        F.when(n % 17 == 0, times.add_seconds(at, -60.0)).when(n % 17 == 1, times.add_seconds(at, 600.0)).when(n % 17 == 2, times.add_seconds(at, 3600.0)).alias("certificate_valid_until"),
        (n % 6 == 0).alias("reissued"), F.when(n % 10 == 0, "revoked").otherwise("active").alias("mandate_status"),
    ).withColumn("decline_category", F.coalesce("_dc", F.lit("soft"))).drop("_dc")


def gate_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a rule asks about a claim and its subject whatever the moment."""
    from dunlin.operators import rules
    s = subjects(spark, d).withColumn("consent", rules.consent_map(F.col("consent"))).drop("subject_token")
    return gate_claims(spark, d).join(s, "cust")


def gate_context(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per claim: subject facts plus bounded arrays of recent contacts and retries.

    The contact filter is on the raw shipping date, so it reaches the scan of the lines before the
    join with their orders.
    """
    from dunlin.operators import rules
    at = at_lit()
    con = contacts(spark, d, since_hours=rules.contact_reach(rules.ruleset.RULES)[1])
    k = rules.recent_contacts(con, "cust", at)
    r = rules.recent_retries(retries(spark, d), "cust", at)
    s = subjects(spark, d).withColumn("consent", rules.consent_map(F.col("consent"))).drop("subject_token")
    empty_c = F.array().cast("array<struct<at_ts:timestamp,channel:string,outcome:string>>")
    person = s.join(k, "cust", "left").join(r, "cust", "left").withColumn("contacts", F.coalesce("contacts", empty_c)).withColumn(
        "retries", F.coalesce("retries", F.array().cast("array<timestamp>")))
    return gate_claims(spark, d).join(person, "cust")
