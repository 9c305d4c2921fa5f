"""From signed deliveries to claims: admission, deduplication, ordering, folding, redaction split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dunlin.functions import hashing, stats, times
from dunlin.operators import scale
from dunlin.session import materialise
from dunlin.sources import dialects

MAX_SIGNATURE_AGE = 48 * 3600
TRIP_AFTER = 20
DEDUPE_SECONDS = 30 * 86400


def classify(deliveries: DataFrame, secrets: dict[str, bytes]) -> DataFrame:
    """Row-local part of admission: signature, freshness and parsing, as one ``verdict`` column."""
    parsed = dialects.parse(deliveries, [s for s in dialects.SOURCES if s in secrets])
    signed = hashing.signed_at(F.col("signature"))
    ok = hashing.signature_ok(F.col("raw"), F.col("signature"), F.col("source"), secrets)
    out = parsed.withColumn("signature_valid", ok).withColumn("signed_at", signed)
    verdict = (F.when(~F.col("known_source"), "unknown_source").when(~F.col("signature_valid"), "signature_invalid")
               .when(times.seconds_between(F.col("received_at"), F.col("signed_at")) > MAX_SIGNATURE_AGE, "signature_stale")
               .when(F.col("event").isNull(), "malformed").otherwise("accepted"))
    event = F.col("event").withField("event_ts", F.when(F.col("event.date_only"), F.coalesce(F.col("signed_at"), F.col("event.event_ts")))
                                     .otherwise(F.col("event.event_ts")))
    return out.withColumn("verdict", verdict).withColumn("event", event)


def consecutive_failures(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], failed: Column, succeeded: Column) -> DataFrame:
    """Add ``fail_run``: failures since the last success, this row included."""
    return scale.run_length(df, keys, bucket, order, failed, succeeded, "fail_run", split=scale.BUCKET_ROWS)


def admit(deliveries: DataFrame, secrets: dict[str, bytes], seen: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """All deliveries with a final ``verdict``: the breaker first, then the row-local checks, then dedupe."""
    rows = materialise(classify(deliveries, secrets), "classified")   # parsed once, read narrowly below
    narrow = rows.select("archive_id", "source", "verdict")
    failed = F.col("verdict").isin("signature_invalid", "malformed")
    runs = consecutive_failures(narrow, ["source"], F.floor(F.col("archive_id") / 65536), [F.col("archive_id")], failed,
                                F.col("verdict") == "accepted")
    # one row per tripped source, and only a source with a secret can trip: sent to every task, for rows that meet by source are a few tasks
    trips = runs.filter(F.col("fail_run") >= TRIP_AFTER).groupBy("source").agg(F.min("archive_id").alias("trip_id"))
    tripped = rows.join(F.broadcast(trips), "source", "left")
    gated = tripped.withColumn("verdict", F.when(F.col("archive_id") > F.col("trip_id"), "tripped").otherwise(F.col("verdict")))
    return dedupe(gated.drop("trip_id"), seen, at)


def dedupe(rows: DataFrame, seen: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Mark accepted repeats of (source, event id) as duplicates; the first arrival is new.

    The first arrival comes from a partially aggregated ``min`` rather than a window, so copies of
    one event never meet in a sort.  ``seen`` are known keys with ``first_seen_at``; a key seen
    strictly more than thirty days before ``at`` counts as new again.  Rows that are not accepted meet nobody,
    so they are spread by their own number instead of all sharing the key of a missing event.
    """
    key = ["source", "_eid"]
    acc = F.col("verdict") == "accepted"
    base = rows.withColumn("_eid", F.col("event.event_id")).withColumn("_apart", F.when(acc, 0).otherwise(F.col("archive_id") + 1).cast("long"))
    first = base.filter(acc).groupBy(*key).agg(F.min("archive_id").alias("_first"))
    if seen is not None:
        live = seen.filter(F.col("first_seen_at") >= times.add_seconds(at, -DEDUPE_SECONDS)).select("source", F.col("event_id").alias("_eid"))
        first = first.join(live, key, "left_anti")
    marked = base.join(first.withColumn("_apart", F.lit(0).cast("long")), [*key, "_apart"], "left")
    dup = acc & (F.col("_first").isNull() | (F.col("archive_id") != F.col("_first")))
    return marked.withColumn("verdict", F.when(dup, "duplicate").otherwise(F.col("verdict"))).drop("_eid", "_first", "_apart")


def accepted_events(admitted: DataFrame) -> DataFrame:
    return admitted.filter(F.col("verdict") == "accepted").select("archive_id", "source", "raw", "received_at", "event.*")


def out_of_order(events: DataFrame, arrival: str = "archive_id") -> DataFrame:
    """Flag arrivals whose event time is below the highest event time of any earlier arrival."""
    chunk = F.floor(F.col(arrival) / 65536)
    r = scale.running(events, [], chunk, [F.col(arrival)], maxes={"_high": F.col("event_ts")})
    return r.withColumn("out_of_order", F.coalesce(F.col("event_ts") < F.col("_high"), F.lit(False))).drop("_high")


ORDER_KEY = ["event_ts", "source", "event_id"]


def event_order(events: DataFrame, day: Column) -> DataFrame:
    """Position of each event in its account's (time, source, id) order."""
    return scale.running(events, ["account_ref"], day, [F.col(c) for c in ORDER_KEY], rank="position", split=scale.BUCKET_ROWS)


def fold_by_account(events: DataFrame) -> DataFrame:
    """One row per account: its last event, failed attempts, and whether a capture superseded failures."""
    failure = F.col("kind").isin(*dialects.FAILURE_KINDS) & ~F.col("succeeded")
    last = F.max_by(F.struct(*[c for c in events.columns if c != "account_ref"]), F.struct(*ORDER_KEY))
    g = events.groupBy("account_ref").agg(last.alias("latest"), F.count_if(failure).alias("failed_attempts"), F.count(F.lit(1)).alias("events"))
    return g.withColumn("resolved", F.col("latest.succeeded")).withColumn("superseded", F.col("latest.succeeded") & (F.col("failed_attempts") > 0))


def identity() -> Column:
    """Customer reference, else phone, else e-mail; NULL when none is usable."""
    def filled(c: Column) -> Column:
        return F.when(F.trim(c) != "", c)
    return F.coalesce(filled(F.col("customer_ref")), filled(F.col("personal.phone")), filled(F.col("personal.email")))


def claim_type() -> Column:
    return (F.when(F.col("kind") == "invoice_overdue", "invoice_overdue").when(F.col("kind") == "checkout_abandoned", "checkout_abandon")
            .when(F.col("rail") == "card", "card_decline").when(F.col("rail").isin("enach", "upi_autopay"), "mandate_failure")
            .when(F.col("rail") == "invoice", "invoice_overdue"))


def evidence(failed_attempts: Column) -> Column:
    pairs = [("source", F.col("source")), ("wire_kind", F.col("kind")), ("rail", F.col("rail")), ("account_ref", F.col("account_ref")),
             ("attempt", F.col("attempt").cast("string")), ("failed_attempts", failed_attempts.cast("string")),
             ("initiated_by", F.col("initiated_by")), ("decline_code", F.col("decline_code")), ("advice_code", F.col("advice_code")),
             ("issuer_ref", F.col("issuer_ref")), ("ageing_bucket", F.col("ageing_bucket")), ("days_overdue", F.col("days_overdue").cast("string")),
             ("mandate_ref", hashing.mandate_ref(F.try_element_at(F.col("personal.identifiers"), F.lit("mandate"))))]
    return F.map_filter(F.create_map(*[x for n, c in pairs for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())


def normalise(folded: DataFrame, pepper: bytes, ltv: Column) -> DataFrame:
    """Pending accounts as normalised rows: claim columns plus a ``record`` struct with the personal part.

    ``ltv`` is a provider expression over the event columns.  The claim side never holds an identifier.
    """
    flat = folded.filter(~F.col("resolved")).select("account_ref", "failed_attempts", "latest.*")
    token = hashing.subject_token(identity(), pepper)
    return flat.select(
        hashing.claim_id(F.col("source"), F.col("event_id")).alias("claim_id"), token.alias("subject_token"), "amount_paise",
        ltv.cast("long").alias("ltv_remaining_paise"), claim_type().alias("claim_type"), "rail", F.col("event_ts").alias("detected_at"),
        evidence(F.col("failed_attempts")).alias("evidence"), F.sha2("raw", 256).alias("evidence_hash"), F.lit("detected").alias("state"),
        "archive_id", "failed_attempts",
        F.struct("source", "event_id", "account_ref", "personal.name", "personal.email", "personal.phone", "personal.narration",
                 "personal.identifiers", F.decode("raw", "utf-8").alias("raw_payload")).alias("record"))


def subject_totals(claims: DataFrame) -> DataFrame:
    """Claims and total per subject, and the rail of the largest claim (the earliest on equal amounts)."""
    return claims.groupBy("subject_token").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum("amount_paise").alias("total_paise"),
        F.max_by("rail", F.struct(F.col("amount_paise"), (-F.col("position")).alias("p"))).alias("rail"))


def decile_positions(totals: DataFrame, column: str) -> DataFrame:
    """(i, value): the nine exact order statistics at positions min(n-1, i·n div 10) of the sorted values.

    Exact ranks come from value counts (one row per distinct value, partially aggregated) and a
    two-level running count.
    """
    counts = totals.groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
    ranked = scale.running(counts, [], scale.value_bucket(counts, column), [F.col(column)], sums={"_hi": F.col("_c")}, totals={"_n": F.col("_c")})
    wanted = F.array(*[F.least(F.col("_n") - 1, F.floor(F.lit(i) * F.col("_n") / 10).cast("long")) for i in range(1, 10)])
    return ranked.select(column, F.col("_hi"), F.col("_c"), F.posexplode(wanted).alias("p", "pos")) \
        .filter((F.col("pos") < F.col("_hi")) & (F.col("pos") >= F.col("_hi") - F.col("_c"))).select((F.col("p") + 1).alias("i"), column)


def decile_cutoffs(totals: DataFrame, column: str = "total_paise") -> list[int]:
    """The nine cut-offs as literals (nine rows are all that reaches the driver)."""
    values = [r[column] for r in decile_positions(totals, column).orderBy("i").collect()]
    return values if values else [0] * 9


def assign_arms(totals: DataFrame, cutoffs: list[int], experiment: str, arms: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Stratum and arm per subject; an arm that is already stored wins."""
    bucket = stats.claim_count_bucket(F.col("claim_count"))
    decile = stats.value_decile(F.col("total_paise"), cutoffs)
    out = totals.withColumn("claim_bucket", bucket).withColumn("value_decile", decile)
    out = out.withColumn("stratum", F.concat_ws("|", "claim_bucket", F.col("value_decile").cast("string"), "rail"))
    out = out.withColumn("computed", hashing.pick_by_share(hashing.arm_draw(experiment, F.col("stratum"), F.col("subject_token")), arms))
    if stored is None:
        return out.withColumnRenamed("computed", "arm").withColumn("newly_assigned", F.lit(True))
    j = out.join(stored.select("subject_token", F.col("arm").alias("_stored")), "subject_token", "left")
    return j.withColumn("arm", F.coalesce("_stored", "computed")).withColumn("newly_assigned", F.col("_stored").isNull()).drop("_stored", "computed")


def claim_violations() -> Column:
    """Names of broken constraints of a claim row (empty when valid)."""
    checks = [
        ("token", ~F.coalesce(F.col("subject_token").rlike("^sub_[0-9a-f]{32}$"), F.lit(False))),
        ("amount", F.coalesce(F.col("amount_paise") < 0, F.lit(True))),
        ("ltv", F.coalesce(F.col("ltv_remaining_paise") < 0, F.lit(True))),
        ("detected_at", F.col("detected_at").isNull()),
        ("hash", F.coalesce(F.length("evidence_hash") != 64, F.lit(True))),
        ("evidence_key", F.exists(F.map_keys("evidence"), lambda k: ~k.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))),
        ("evidence_value", F.exists(F.map_values("evidence"), lambda v: F.length(v) > 128)),
    ]
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks]), lambda x: x.isNotNull())


def next_record_seq(existing: DataFrame, incoming: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Sequence numbers continue after the highest one stored for the subject."""
    top = existing.groupBy("subject_token").agg(F.max("record_seq").alias("_top"))
    r = scale.running(incoming, ["subject_token"], bucket, [F.col(c) for c in order], rank="_rn", split=scale.BUCKET_ROWS)
    return r.join(top, "subject_token", "left").withColumn("record_seq", F.coalesce("_top", F.lit(0)) + F.col("_rn")).drop("_top", "_rn")
