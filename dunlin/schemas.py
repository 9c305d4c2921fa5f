"""Declared schemas.  Nothing in the library infers a schema."""

from __future__ import annotations

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

DELIVERY = "archive_id long, source string, raw binary, signature string, received_at timestamp"

# One struct per dialect; every leaf that may arrive as a number or a string is read as a string.
_CUSTOMER = "id string, name string, email string, contact string"
_NOTES = "account_id string, attempt string, initiated_by string"
PGW_BODY = (
    "event string, created_at string, payload struct<"
    f"payment: struct<id string, amount string, status string, card struct<last4 string, network string, issuer string>,"
    f" error_reason string, error_description string, merchant_advice_code string, customer struct<{_CUSTOMER}>,"
    f" notes struct<{_NOTES}>, attempts string>,"
    f"order: struct<id string, amount string, status string, card struct<last4 string, network string, issuer string>,"
    f" error_reason string, error_description string, merchant_advice_code string, customer struct<{_CUSTOMER}>,"
    f" notes struct<{_NOTES}>, attempts string>>"
)
NACH_BODY = (
    "message_type string, umrn string, transaction_id string, settlement_date string, amount string,"
    " return_code string, destination_bank string,"
    " customer struct<name string, account_last4 string, ifsc string, mobile string>, narration string,"
    f" reference struct<{_NOTES}>"
)
UPI_BODY = (
    "event string, mandate_id string, txn_id string, timestamp string, amount_paise string,"
    " npci_error_code string, npci_error_desc string, issuer string,"
    f" payer struct<vpa string, name string, mobile string>, ref struct<{_NOTES}>"
)
BILLING_BODY = (
    "type string, created_at string, invoice struct<id string, amount_due string, due_date string,"
    " days_overdue string, ageing_bucket string, buyer struct<name string, email string, contact string, gstin string>>,"
    f" ref struct<{_NOTES}>"
)
