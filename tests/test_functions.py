"""Column functions against plain Python."""

import hashlib
import hmac
import re
import uuid

from pyspark.sql import functions as F

from dunlin import dims
from dunlin.functions import hashing, money, stats, text, times


def one(spark, col, **vals):
    row = spark.createDataFrame([tuple(vals.values())], list(vals)) if vals else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_hmac_short_and_long_keys(spark):
    for key in (b"k" * 20, b"k" * 100):
        got = one(spark, hashing.hmac_sha256(key, F.encode(F.col("m"), "utf-8")), m="hello")
        assert got == hmac.new(key, b"hello", hashlib.sha256).hexdigest()


def test_uuid5(spark):
    got = one(spark, hashing.uuid5(hashing.CLAIM_SPACE, F.col("m")), m="pgw\x1fevt_1")
    assert got == str(uuid.uuid5(uuid.UUID(hashing.CLAIM_SPACE), "pgw\x1fevt_1"))


def test_unit_draw(spark):
    got = one(spark, hashing.unit_draw(F.col("m")), m="abc")
    assert got == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") / 2 ** 64


def test_money_text(spark):
    df = spark.createDataFrame([("1299",), ("1299.5",), (" 1299.05 ",), ("1.234",), ("-3",), ("Rs 4",)], ["t"])
    assert [r[0] for r in df.select(money.paise_from_text(F.col("t"))).collect()] == [129900, 129950, 129905, None, None, None]


def test_inr_grouping(spark):
    df = spark.createDataFrame([(5,), (12345678901,), (-9990000,)], ["p"])
    assert [r[0] for r in df.select(money.format_inr(F.col("p"))).collect()] == ["₹0.05", "₹12,34,56,789.01", "-₹99,900.00"]


def test_contact_window_boundaries(spark):
    rows = [("2026-03-17 02:29:00", "2026-03-17 02:30:00"), ("2026-03-17 02:30:00", "2026-03-17 02:30:00"), ("2026-03-17 13:29:59", "2026-03-17 13:29:59"),
            ("2026-03-17 13:30:00", "2026-03-18 02:30:00")]     # Kolkata 07:59, 08:00, 18:59, 19:00
    df = spark.createDataFrame(rows, ["a", "b"])
    got = df.select(times.next_contact_window(F.to_timestamp("a"), F.lit("Asia/Kolkata")).cast("string").alias("x"), "b").collect()
    assert all(r["x"] == r["b"] for r in got)


def test_half_even_horizon(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-03 12:00:00"), ("2024-01-01 00:00:00", "2024-01-04 12:00:00"), ("2024-01-01 00:00:00", "2024-01-01 01:00:00")], ["a", "b"])
    got = [r[0] for r in df.select(times.promise_horizon_days(F.to_timestamp("a"), F.to_timestamp("b"))).collect()]
    assert got == [2, 4, 1]


def test_category_bucket(spark):
    v = "upi_autopay"
    want = float(sum(b * (31 ** i % 1000003) for i, b in enumerate(v.encode())) % 64)
    assert one(spark, hashing.category_bucket(F.col("v")), v=v) == want


def test_ewma(spark):
    rates = [0.1, 0.5, 0.2, 0.9]
    mu, var = rates[0], 0.0
    for r in rates[1:]:
        var = 0.25 * (r - mu) ** 2 + 0.75 * var
        mu = 0.25 * r + 0.75 * mu
    got = one(spark, stats.ewma(F.col("r")), r=rates)
    assert abs(got["mu"] - mu) < 1e-12 and abs(got["var"] - var) < 1e-12
    assert one(spark, stats.ewma(F.array().cast("array<double>"))) == (0.0, 0.0)


# ---- text, against a direct span-based scan ------------------------------------------------------
def scan(textv):
    masked = textv
    for p in dims.PII_MASKS:
        masked = re.sub(p, lambda m: "#" * len(m.group(0)), masked)
    taken, out = [], []

    def take(kind, s, e):
        if not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            out.append((kind, e - s))
    for kind, p in dims.PII_PATTERNS:
        for m in re.finditer(p, masked):
            if kind == "card_pan":
                d = re.sub(r"\D", "", m.group(0))
                tot = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d)))
                if not (13 <= len(d) <= 19 and tot % 10 == 0):
                    continue
            take(kind, *m.span())
    return sorted(out)


CASES = ["write to a.b@example.com or 9876543210 now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "PAN ABCDE1234F, IFSC HDFC0123456", "aadhaar 1234 5678 9012",
         "id sub_0123456789abcdef0123456789abcdef only", "acct 123456789 +91 9876543210", "nothing here", "été 123456789012345 à"]


def test_pii_kinds_match_a_span_scan(spark):
    df = spark.createDataFrame([(c,) for c in CASES], ["t"])
    for r in df.select("t", text.pii_hits(F.col("t")).alias("h")).collect():
        got = sorted((h["kind"], h["length"]) for h in r["h"] if h["kind"] != "name_token")
        assert got == scan(r["t"]), r["t"]


def test_name_runs(spark):
    df = spark.createDataFrame([("ACH DR RTN CHG 1 RAMESH KUMAR UMRN",), ("Paid by Asha Rao today",), ("Card Declined Payment",), ("Single Name9",)], ["t"])
    got = [list(r[0]) for r in df.select(text.name_run_words(F.col("t"))).collect()]
    assert got[1] == ["Asha", "Rao"] and got[2] == [] and got[3] == []
    assert "RAMESH" in got[0] and "KUMAR" in got[0]


def test_redaction(spark):
    out, removed = text.redact(F.col("t"))
    r = spark.createDataFrame([("mail x@y.co pan ABCDE1234F",)], ["t"]).select(out.alias("o"), removed.alias("r")).first()
    assert r["o"] == "mail [email] pan [pan]" and list(r["r"]) == ["pan", "email"]


def test_grounding_removes_longest_fact_first(spark):
    facts = F.array(F.lit("₹100"), F.lit("₹1000"))
    assert list(one(spark, text.ungrounded_figures(F.col("t"), facts), t="pay ₹1000 now")) == []
    assert list(one(spark, text.ungrounded_figures(F.col("t"), facts), t="pay ₹999 now")) == ["₹999"]
