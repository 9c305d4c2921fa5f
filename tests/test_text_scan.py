"""Personal-data scan and redaction against plain regular-expression loops."""

import hashlib
import re

from pyspark.sql import functions as F

from conftest import SF
from dunlin import dims
from dunlin.functions import text


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def scan(t):
    t = t or ""
    hits = []
    for p in dims.PII_MASKS:
        t = re.sub(p, "#", t)
    for kind, p in dims.PII_PATTERNS:
        if kind == "card_pan":
            t = t.replace("\x01", " ").replace("\x02", " ")
            ok = lambda v: len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))
            hits += [(kind, m) for m in re.findall(p, t) if ok(m)]
            t = re.sub(p, lambda m: "|" if ok(m.group()) else m.group(), t)
        else:
            hits += [(kind, m) for m in re.findall(p, t)]
            t = re.sub(p, "|", t)
    if re.search(r"\s", t):
        names = "|".join([*dims.NON_NAMES, *(w[0] + w[1:].lower() for w in dims.NON_NAMES)])
        word = r"(?:[A-Z][a-z]{2,19}|[A-Z]{3,20})"
        cleared = re.sub(rf"\b(?:{names})\b", "|", t)
        hits += [("name_token", w) for run in re.findall(rf"\b{word}(?:\s+{word})+\b", cleared) for w in re.split(r"\s+", run)]
    return sorted((k, len(v), hashlib.sha256(v.encode()).hexdigest()[:8]) for k, v in hits)


def texts(spark):
    odd = [None, "", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "4111111111111111@x.example.com", "sub_" + "a" * 32, "ABCDE1234F x ABCDE1234FG", "HDFC0ABC123", "+91 9876543210 919876543210",
           "1234 5678 9012", "acct 123456789012345678", "Ravi Kumar PAID BANK Sharma Devi", "a.b+c@mail-x.example", "0" * 40, "é9876543210é", "12-3456-7890-1234-5", "9" * 2000, "JOHN SMITH " * 300]
    docs = [(i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    return docs + [(100_000 + i, t) for i, t in enumerate(odd)]


def test_scan_equals_loops(spark):
    rows = texts(spark)
    df = spark.createDataFrame(rows, "id long, t string").repartition(8)
    got = {r["id"]: sorted(tuple(h) for h in r["pii"]) for r in text.scan_pii(df, "t").collect()}
    assert sum(map(len, got.values())) > 50
    for i, t in rows:
        assert got[i] == scan(t), i


def test_redaction_by_steps_equals_the_chain_and_loops(spark):
    rows = texts(spark)
    df = spark.createDataFrame(rows, "id long, t string").repartition(8)
    out, removed = text.redact(F.col("t"))
    chain = {r["id"]: (r["o"], r["r"]) for r in df.select("id", out.alias("o"), removed.alias("r")).collect()}
    seen = set()
    for r in text.redact_rows(df, "t").collect():
        assert (r["redacted"], r["removed"]) == chain[r["id"]]
        t, kinds = r["t"], []
        for kind, p in dims.REDACTIONS if t is not None else ():
            new = re.sub(p, f"[{kind}]", t)
            kinds += [kind] if new != t else []
            t = new
        assert (r["redacted"], r["removed"]) == (t, kinds)
        seen.update(kinds)
    assert seen >= {"card", "email", "mobile", "pan"}


def test_stop_intents_are_read_from_the_turns(spark):
    from dunlin.plans.q_models import stop_intents
    rows = [(1, 0, "user", "Hello. I LOST my job, last week"), (1, 1, "assistant", "wrong number?"), (2, 0, "user", "I will pay tomorrow, call me back"), (2, 1, "user", "This is not a wrong number."),
            (3, 0, "user", "please let me speak to a human"), (3, 1, "user", "wrong number"), (4, 0, "assistant", "you never took this loan"), (4, 1, "user", None), (5, 0, "user", "I can\'t afford it; no money"), (6, 0, None, "wrong number")]
    got = {r["conv_id"]: (r["stop_intent"], r["stop_turn"], r["actionable"]) for r in stop_intents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: ("hardship", 0, 1), 2: ("", -1, 1), 3: ("request_human", 0, 2), 4: ("", -1, 0), 5: ("hardship", 0, 1), 6: ("", -1, 0)}
