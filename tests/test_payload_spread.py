"""The payload walk is dealt out by its rows; a text that cannot hold a kind is not searched for it."""

from dunlin.functions import text
from dunlin.plans import q_models
from dunlin.session import spread

SF = "/root/testdata/sf0.001"


def test_payloads_are_dealt_out_however_few_row_groups(spark, monkeypatch):
    assert spread(spark.range(1000, numPartitions=1), 10).rdd.getNumPartitions() == 100
    monkeypatch.setattr(q_models, "PAYLOAD_ROWS", 10)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert q_models.x02(spark, SF).rdd.getNumPartitions() >= n // 10


def test_kinds_that_control_characters_part_are_found(spark):
    rows = [("1234\x015678\x029012", ["aadhaar"]), ("Ravi\x01Kumar ", ["name_token", "name_token"]), ("4111\x011111\x021111 1111", ["card_pan"]),
            ("ABCD0EFGHIJ", ["ifsc"]), ("ABCDE1234F", ["pan_card"]), ("amount_paise", []), ("123456789", ["bank_account"]), ("sub_" + "a" * 32, [])]
    got = {r["t"]: [h["kind"] for h in r["pii"]] for r in text.scan_pii(spark.createDataFrame([(t,) for t, _ in rows], "t string"), "t").collect()}
    assert got == dict(rows)
