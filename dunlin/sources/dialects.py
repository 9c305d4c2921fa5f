"""Four wire dialects parsed into one event shape, in a single pass over the deliveries.

Each row is parsed only by the schema of its own source (``when(source = ...)`` around
``from_json``), so there is one scan and no union of filtered branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunlin import schemas
from dunlin.functions import times
from dunlin.functions.money import paise_from_text

SOURCES = ["pgw", "npci_nach", "upi_autopay", "billing"]
# fixed values: wire names per dialect
KINDS = {
    "pgw": {"payment.captured": "debit_captured", "payment.failed": "debit_failed", "checkout.abandoned": "checkout_abandoned"},
    "npci_nach": {"ACH_DR_SETTLED": "debit_captured", "ACH_DR_RETURN": "debit_failed"},
    "upi_autopay": {"autopay.debit.success": "debit_captured", "autopay.debit.failed": "debit_failed"},
    "billing": {"invoice.overdue": "invoice_overdue"},
}
FAILURE_KINDS = ["debit_failed", "checkout_abandoned", "invoice_overdue"]


def _kind(source: str, name: Column) -> Column:
    out = F.lit(None).cast("string")
    for wire, kind in KINDS[source].items():
        out = F.when(name == wire, kind).otherwise(out)
    return out


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^-?\d+$"), c).try_cast("long")


def _text(c) -> Column:
    return c.cast("string") if c is not None else F.lit(None).cast("string")


def _event(event_id, ts, kind, rail, account, amount, succeeded, attempt, initiated, customer=None, decline=None, advice=None,
           issuer=None, ageing=None, overdue=None, date_only=False, name=None, email=None, phone=None, narration=None,
           identifiers=()) -> Column:
    """One event struct, NULL where a required field is missing or malformed."""
    none = F.lit(None).cast("string")
    ids = F.map_filter(F.create_map(*[x for n, c in identifiers for x in (F.lit(n), c)]), lambda _, v: v.isNotNull()) \
        if identifiers else F.create_map().cast("map<string,string>")
    body = F.struct(
        event_id.alias("event_id"), ts.alias("event_ts"), kind.alias("kind"), F.lit(rail).alias("rail"), account.alias("account_ref"),
        _text(customer).alias("customer_ref"), amount.alias("amount_paise"), succeeded.alias("succeeded"),
        F.coalesce(attempt, F.lit(1)).cast("long").alias("attempt"), F.coalesce(initiated, F.lit("merchant")).alias("initiated_by"),
        _text(decline).alias("decline_code"), _text(advice).alias("advice_code"), _text(issuer).alias("issuer_ref"),
        _text(ageing).alias("ageing_bucket"), (overdue if overdue is not None else F.lit(None)).cast("long").alias("days_overdue"),
        F.lit(date_only).alias("date_only"),
        F.struct(_text(name).alias("name"), _text(email).alias("email"), _text(phone).alias("phone"), _text(narration).alias("narration"),
                 ids.alias("identifiers")).alias("personal"))
    ok = event_id.isNotNull() & ts.isNotNull() & kind.isNotNull() & account.isNotNull() & amount.isNotNull() & (
        F.coalesce(initiated, F.lit("merchant")).isin("merchant", "gateway"))
    if customer is not None:
        ok = ok & customer.isNotNull()
    return F.when(ok, body)


def _nonzero(*cs: Column) -> Column:
    """First of several counters that is present and not zero."""
    return F.coalesce(*[F.when(_int(c) != 0, _int(c)) for c in cs])


def pgw_event(j: Column) -> Column:
    kind = _kind("pgw", j["event"])

    def f(path: str) -> Column:
        def get(e: Column) -> Column:
            for p in path.split("."):
                e = e[p]
            return e
        return F.when(kind == "checkout_abandoned", get(j["payload"]["order"])).otherwise(get(j["payload"]["payment"]))
    return _event(f("id"), times.epoch_to_ts(j["created_at"]), kind, "card", f("notes.account_id"), _int(f("amount")),
                  F.coalesce(f("status") == "captured", F.lit(False)), _nonzero(f("notes.attempt"), f("attempts")), f("notes.initiated_by"),
                  customer=f("customer.id"), decline=f("error_reason"), advice=f("merchant_advice_code"), issuer=f("card.issuer"),
                  name=f("customer.name"), email=f("customer.email"), phone=f("customer.contact"), narration=f("error_description"),
                  identifiers=(("card_last4", f("card.last4")),))


def nach_event(j: Column) -> Column:
    kind = _kind("npci_nach", j["message_type"])
    ref, cust = j["reference"], j["customer"]
    return _event(j["transaction_id"], F.when(cust.isNotNull(), times.iso_to_ts(j["settlement_date"])), kind, "enach", ref["account_id"],
                  paise_from_text(j["amount"]), kind == "debit_captured", _nonzero(ref["attempt"]), ref["initiated_by"],
                  decline=j["return_code"], issuer=j["destination_bank"], date_only=True, name=cust["name"], phone=cust["mobile"],
                  narration=j["narration"], identifiers=(("mandate", j["umrn"]), ("ifsc", cust["ifsc"]), ("account_last4", cust["account_last4"])))


def upi_event(j: Column) -> Column:
    kind = _kind("upi_autopay", j["event"])
    ref, payer = j["ref"], j["payer"]
    return _event(j["txn_id"], F.when(payer.isNotNull(), times.iso_to_ts(j["timestamp"])), kind, "upi_autopay", ref["account_id"],
                  _int(j["amount_paise"]), kind == "debit_captured", _nonzero(ref["attempt"]), ref["initiated_by"],
                  decline=j["npci_error_code"], issuer=j["issuer"], name=payer["name"], phone=payer["mobile"], narration=j["npci_error_desc"],
                  identifiers=(("mandate", j["mandate_id"]), ("vpa", payer["vpa"])))


def billing_event(j: Column) -> Column:
    inv, ref = j["invoice"], j["ref"]
    buyer = inv["buyer"]
    return _event(inv["id"], F.when(buyer.isNotNull(), times.epoch_to_ts(j["created_at"])), _kind("billing", j["type"]), "invoice", ref["account_id"],
                  paise_from_text(inv["amount_due"]), F.lit(False), _nonzero(ref["attempt"]), F.lit("merchant"), ageing=inv["ageing_bucket"],
                  overdue=_int(inv["days_overdue"]), name=buyer["name"], email=buyer["email"], phone=buyer["contact"],
                  identifiers=(("gstin", buyer["gstin"]),))


BODIES = {"pgw": (schemas.PGW_BODY, pgw_event), "npci_nach": (schemas.NACH_BODY, nach_event),
          "upi_autopay": (schemas.UPI_BODY, upi_event), "billing": (schemas.BILLING_BODY, billing_event)}


def parse(deliveries: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Add ``event`` (NULL when malformed) and ``known_source``; the other columns stay."""
    out = deliveries.withColumn("_text", F.decode("raw", "utf-8"))
    use = sources or SOURCES
    for s in use:
        out = out.withColumn(f"_j_{s}", F.when(F.col("source") == s, F.from_json("_text", BODIES[s][0])))
    event = F.coalesce(*[F.when(F.col("source") == s, BODIES[s][1](F.col(f"_j_{s}"))) for s in use])
    out = out.withColumn("event", event).withColumn("known_source", F.col("source").isin(use))
    return out.drop("_text", *[f"_j_{s}" for s in use])
