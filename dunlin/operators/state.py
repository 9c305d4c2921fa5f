"""State as tables: transitions, queue, reservations, ledgers, erasure, breakers.

A move on a table is a new snapshot: the operators return the next table, and the writer replaces the
previous one.  Nothing locks a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dunlin import dims
from dunlin.functions import hashing, times
from dunlin.operators import scale


# ---- claims --------------------------------------------------------------------------------------
def legal_move(frm: Column, dest: Column, edges=None) -> Column:
    """Is the move one of the listed edges?  (29 pairs: a literal test, no join.)"""
    pairs = [f"{a}>{b}" for a, b in (edges or dims.STATE_EDGES)]
    return F.concat(frm, F.lit(">"), dest).isin(*pairs)


def apply_transitions(claims: DataFrame, moves: DataFrame) -> DataFrame:
    """Outcome of each requested move and the state after it.

    ``moves``: claim_id, expected, dest.  A move applies when it is legal and the stored state is the
    expected one.
    """
    j = moves.join(claims.select("claim_id", "state"), "claim_id", "left")
    out = (F.when(~legal_move(F.col("expected"), F.col("dest")), "illegal").when(F.col("state").isNull(), "not_found")
           .when(F.col("state") != F.col("expected"), "concurrent").otherwise("applied"))
    return j.withColumn("outcome", out).withColumn("after", F.when(out == "applied", F.col("dest")).otherwise(F.col("state")))


# ---- queue ------------------------------------------------------------------------------------------
def idempotency_key(claim: Column, action: Column, cycle: Column, certificate: Column) -> Column:
    return F.sha2(F.concat_ws(":", claim, action, cycle, certificate), 256)


def ready(outbox: DataFrame, at: Column, limit: int) -> DataFrame:
    """The next rows to send; ``orderBy.limit`` is a bounded heap per task, not a global sort."""
    due = outbox.filter((F.col("status") == "pending") & (F.col("not_before") <= at))
    return due.orderBy(F.desc("priority"), "not_before", "claim_id").limit(limit)


def dispatch_outcome(at: Column, handled: list[str], channel: Column, failing: Column, permanent: Column, max_attempts: int = 6) -> Column:
    """Outcome of a row at its turn, one of five words.

    The tests run from what makes sending unlawful, over what makes it pointless or impossible, to what may pass with time."""
    covers = at.between(F.col("cert_valid_from"), F.col("cert_valid_until"))
    return (F.when(~covers, "cert_expired").when(F.col("state").isin(*dims.ABSORBING_STATES), "terminal_state").when(~channel.isin(*handled), "dead")
            .when(permanent, "dead").when(failing & (F.col("attempts") >= max_attempts), "dead").when(failing, "rescheduled").otherwise("sent"))


def freeze(outbox: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(next queue, held rows): pending and failed rows are held and cancelled."""
    hit = F.col("status").isin("pending", "failed")
    held = outbox.filter(hit).select("claim_id", "subject_token", "idempotency_key", "action", at.alias("held_at"))
    return outbox.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))), held.dropDuplicates(["idempotency_key"])


def stop_key(name: Column, claim: Column, subject: Column, tenant: Column) -> Column:
    """What an event is matched on: its claim, its subject or the tenant; NULL means the key is missing."""
    field = dims.lookup(name, dims.EVENT_MATCH)
    return F.when(field == "claim_id", claim).when(field == "subject_token", subject).when(field == "tenant_id", tenant)


def earliest_stop(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """First stop event at or after each subscription's start, on (name, match key).

    An as-of join: subscriptions and events stand in one order, latest first, and each subscription takes
    the nearest event before it.  A key that every run subscribes to is cut along the time.
    """
    when = lambda c: -F.unix_micros(c)
    ev = events.filter("match_key is not null").groupBy("name", "match_key", "occurred_at").agg(F.min("event_seq").alias("event_seq"))
    hit = F.struct(when("occurred_at").alias("t"), (-F.col("event_seq")).alias("s"))
    none = F.lit(None)
    rows = subscriptions.filter("match_key is not null").select("name", "match_key", when("since").alias("t"), F.lit(1).alias("k"), F.col("run_id"), none.cast("struct<t:bigint,s:bigint>").alias("hit")).unionByName(
        ev.select("name", "match_key", when("occurred_at").alias("t"), F.lit(0).alias("k"), none.cast("long").alias("run_id"), hit.cast("struct<t:bigint,s:bigint>").alias("hit")))
    near = scale.running(rows, ["name", "match_key"], scale.value_bucket(rows, "t"), [F.col("t"), F.col("k")], maxes={"next": F.col("hit")})
    j = near.filter("run_id is not null and next is not null").select(
        "run_id", "name", "match_key", F.timestamp_micros(-F.col("next.t")).alias("occurred_at"), (-F.col("next.s")).alias("event_seq"))
    return j.groupBy("run_id").agg(F.min_by(F.struct("name", "match_key", "occurred_at", "event_seq"), F.struct("occurred_at", "event_seq")).alias("hit")).select("run_id", "hit.*")


# ---- reservations --------------------------------------------------------------------------------------
def remaining(reservations: DataFrame, caps: DataFrame) -> DataFrame:
    """cap - hard held, per budget."""
    held = reservations.filter(F.col("status") == "hard").groupBy("budget").agg(F.sum("amount").alias("held"))
    return caps.join(held, "budget", "left").select("budget", "cap", F.coalesce("held", F.lit(0)).alias("held"), (F.col("cap") - F.coalesce("held", F.lit(0))).alias("remaining"))


def move_reservations(reservations: DataFrame, keys: DataFrame, op: str) -> DataFrame:
    """Release, consume or harden the live reservations of some keys; ``credit`` is what a cap gets back."""
    to = {"release": "released", "consume": "consumed", "harden": "hard", "expire": "expired"}[op]
    frm = {"release": ["soft", "hard"], "consume": ["hard"], "harden": ["soft"], "expire": ["soft", "hard"]}[op]
    j = reservations.join(keys.select("idempotency_key").distinct().withColumn("_hit", F.lit(True)), "idempotency_key", "left")
    act = F.coalesce("_hit", F.lit(False)) & F.col("status").isin(*frm)
    credit = F.when(act & (F.col("status") == "hard") & F.lit(op in ("release", "expire")), F.col("amount")).otherwise(F.lit(0))
    return j.withColumn("credit", credit.cast("long")).withColumn("status", F.when(act, to).otherwise(F.col("status"))).drop("_hit")


# ---- money ---------------------------------------------------------------------------------------------
def balances(entries: DataFrame) -> DataFrame:
    """Per claim and account, per claim, and in total (ROLLUP)."""
    return entries.rollup("claim_no", "account").agg(F.sum("delta_paise").alias("balance"))


def unbalanced_groups(entries: DataFrame) -> DataFrame:
    return entries.groupBy("group_id").agg(F.sum("delta_paise").alias("total")).filter(F.col("total") != 0)


def money_moves(moves: DataFrame, bucket: Column) -> DataFrame:
    """Legality of each movement and the balance it draws on, in (claim, time, group) order."""
    order = [F.col("occurred_at"), F.col("group_id")]
    legs = moves.select("claim_no", "occurred_at", "group_id", "frm", "to", "amount", F.inline(F.array(
        F.struct(F.col("frm").alias("account"), (-F.col("amount")).alias("d"), F.lit(True).alias("source")),
        F.struct(F.col("to").alias("account"), F.col("amount").alias("d"), F.lit(False).alias("source")))))
    run = scale.running(legs, ["claim_no", "account"], bucket, [*order, F.col("source")], sums={"after": F.col("d")}, split=scale.BUCKET_ROWS)
    src = run.filter("source")
    legal = legal_move(F.col("frm"), F.col("to"), dims.MONEY_EDGES)
    return src.withColumn("available", F.col("after") + F.col("amount")).withColumn(
        "outcome", F.when(~legal, "illegal").when((F.col("frm") != "external") & (F.col("amount") > F.col("available")), "insufficient").otherwise("ok"))


# ---- decision ledger -------------------------------------------------------------------------------------
SEGMENT = 256


def segmented(rows: DataFrame, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Chain segments: consecutive runs of at most 256 entries per key, by exact position."""
    r = scale.running(rows, keys, bucket, order, rank="seq", split=scale.BUCKET_ROWS)
    return r.withColumn("segment", F.floor((F.col("seq") - 1) / SEGMENT).cast("long"))


def chain(rows: DataFrame, keys: list[str], body: Column) -> DataFrame:
    """Hash chain within each (key, segment): one row per entry with prev_hash and entry_hash.

    A chain is sequential by nature; a segment bounds the group to 256 short entries however long the
    key's history is, and segments run in parallel.  A key with at most 256 entries is one chain.
    """
    g = rows.withColumn("_body", body).groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("_body").alias("body")))).alias("e"))
    first = F.array(F.lit(hashing.GENESIS))
    hashes = F.aggregate("e", first, lambda acc, x: F.concat(acc, F.array(hashing.chain_step(F.element_at(acc, -1), x["body"]))))
    return g.withColumn("h", hashes).select(*keys, "segment", F.posexplode("e").alias("p", "x"), "h").select(
        *keys, "segment", "x.seq", "x.body", F.get("h", F.col("p")).alias("prev_hash"), F.get("h", F.col("p") + 1).alias("entry_hash"))


def chain_heads(rows: DataFrame, keys: list[str], body: Column) -> DataFrame:
    """Head hash per (key, segment)."""
    g = rows.withColumn("_body", body).groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("_body").alias("body")))).alias("e"))
    return g.select(*keys, "segment", F.size("e").alias("entries"), F.aggregate("e", F.lit(hashing.GENESIS), lambda a, x: hashing.chain_step(a, x["body"])).alias("head"))


def verify(ledger: DataFrame, keys: list[str], inner_seq: Column) -> DataFrame:
    """Breaks of a stored ledger: gap, broken back-link, altered body, altered inner number.

    The only thing a row needs from another is its predecessor's hash and number; the chain segment is
    the window partition, so a long key is verified by many tasks.
    """
    w = W.partitionBy(*keys, "segment").orderBy("seq")
    prev_h = F.coalesce(F.lag("entry_hash").over(w), F.lit(hashing.GENESIS))
    prev_s = F.coalesce(F.lag("seq").over(w), F.col("segment") * SEGMENT)
    x = ledger.withColumn("_ph", prev_h).withColumn("_ps", prev_s)
    reasons = F.array(F.when(F.col("seq") != F.col("_ps") + 1, F.lit("gap")), F.when(F.col("prev_hash") != F.col("_ph"), F.lit("prev_hash")),
                      F.when(hashing.chain_step(F.col("prev_hash"), F.col("body")) != F.col("entry_hash"), F.lit("body")),
                      F.when(F.coalesce(inner_seq != F.col("seq"), F.lit(True)), F.lit("inner_seq")))
    return x.withColumn("breaks", F.filter(reasons, lambda r: r.isNotNull())).drop("_ph", "_ps")


# ---- personal records and erasure -----------------------------------------------------------------------
def encrypt(payload: Column, key: Column, aad: Column) -> Column:
    """AES-GCM under the subject's own key; a destroyed (NULL) key gives NULL."""
    return F.aes_encrypt(payload, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad)


def read_record(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Join the key; a shredded subject and an unknown one are different answers."""
    j = records.join(keys.select("subject_token", "data_key", F.lit(True).alias("_known")), "subject_token", "left")
    status = F.when(F.col("_known").isNull(), "unknown").when(F.col("data_key").isNull(), "shredded").otherwise("readable")
    plain = F.when(F.col("data_key").isNotNull(), F.try_aes_decrypt("cipher", "data_key", F.lit("GCM"), F.lit("DEFAULT"), F.col("subject_token")).cast("string"))
    return j.withColumn("status", status).withColumn("plain", plain).drop("_known", "data_key")


def erase(table: DataFrame, erased: DataFrame) -> DataFrame:
    """The table without the rows of erased subjects."""
    return table.join(erased.select("subject_token").distinct(), "subject_token", "left_anti")


# ---- breakers ----------------------------------------------------------------------------------------------
def judge(readings: DataFrame, specs: DataFrame, min_sample: int = dims.BREAKER_MIN_SAMPLE) -> DataFrame:
    """Verdict of each reading against its specification (ten rows, listed in the vocabulary)."""
    j = readings.join(F.broadcast(specs), "breaker_id")
    thin = (F.col("sample") > 0) & (F.col("sample") < min_sample)
    ratio = F.col("comparison") == "ratio_of_baseline"
    blind = ratio & (F.col("baseline").isNull() | (F.col("baseline") <= 0))
    limit = F.when(ratio, F.col("threshold") * F.col("baseline")).otherwise(F.col("threshold"))
    return j.withColumn("limit", F.when(~thin & ~blind, limit)).withColumn("tripped", F.coalesce(~thin & ~blind & (F.col("observed") > limit), F.lit(False)))


def breaker_history(judged: DataFrame) -> DataFrame:
    """Newly tripped evaluations, and the moment the current trip began.  One row per breaker and
    evaluation, so the ten window partitions are short."""
    w = W.partitionBy("breaker_id").orderBy("evaluated_on")
    prev = F.coalesce(F.lag("tripped").over(w), F.lit(False))
    x = judged.withColumn("newly", F.col("tripped") & ~prev)
    begin = F.max(F.when(F.col("newly"), F.col("evaluated_on"))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return x.withColumn("tripped_on", F.when(F.col("tripped"), begin))


# ---- promises -------------------------------------------------------------------------------------------------
def promise_outcomes(promises: DataFrame, payments: DataFrame, at: Column, grace_hours: float = 36.0) -> DataFrame:
    """KEPT by the deadline, BROKEN after it, UNRESOLVED while it is open."""
    first = payments.groupBy("claim_no").agg(F.min("paid_at").alias("paid_at"))
    j = promises.join(first, "claim_no", "left").withColumn("deadline", times.add_seconds(F.col("due_at"), grace_hours * 3600))
    out = (F.when(F.col("paid_at") <= F.col("deadline"), "kept").when(F.col("paid_at").isNotNull(), "broken").when(at <= F.col("deadline"), "unresolved").otherwise("broken"))
    return j.withColumn("outcome", out)
