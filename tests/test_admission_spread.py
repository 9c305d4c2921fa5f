"""No join of the admission lets the rows of a source, or all rows without an event, meet in one task."""

import pytest
from pyspark.sql import functions as F

from dunlin.operators import ingest
from dunlin.sources import bridge as B

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """Joins by shuffle unless the code asks for more, and shuffles as they are."""
    old = {k: spark.conf.get(k) for k in ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_rejected_rows_do_not_share_a_task(plain):
    rows = plain.range(4000).select(F.col("id").alias("archive_id"), F.lit("pgw").alias("source"), F.lit("malformed").alias("verdict"),
                                    F.lit(None).cast("struct<event_id:string>").alias("event"))
    out = ingest.dedupe(rows)
    most = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert set(out.columns) == set(rows.columns) and out.filter("verdict = 'malformed'").count() == 4000 and most < 2000


def test_trips_are_sent_to_the_rows(plain):
    out = ingest.admit(B.deliveries(plain, SF), B.SECRETS)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_deliveries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(B, "DELIVERY_ROWS", 10)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert B.deliveries(spark, SF).rdd.getNumPartitions() >= n // 10
