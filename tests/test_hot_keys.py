"""A key-day that holds a third of all rows is cut along its order, and nothing else changes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dunlin.operators import scale

T0 = dt.datetime(2024, 1, 1)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        if k % 3 == 0:           # one key and day, half of it in one moment
            rows.append(("hot", T0 + dt.timedelta(seconds=0 if k % 2 else rng.randint(0, 80000)), f"e{k:07d}", rng.randint(-5, 9), rng.random() < 0.6))
        else:
            rows.append((None if k % 50 == 1 else f"k{rng.randint(0, 20)}", T0 + dt.timedelta(days=rng.randint(0, 29), seconds=rng.randint(0, 80000)), f"e{k:07d}", rng.randint(-5, 9), rng.random() < 0.6))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rows_of(30_000), "account string, at timestamp, id string, d long, ok boolean").cache()


ORDER = ["at", "id"]


def test_largest_bucket_is_bounded(spark, events):
    order = [F.col(c) for c in ORDER]
    for df, factor in ((events, 1), (events.unionByName(events.withColumn("id", F.concat("id", F.lit("x")))).unionByName(events.withColumn("id", F.concat("id", F.lit("y")))), 3)):
        cut = scale.split_hot(df.withColumn("_bkt", F.to_date("at")), ["account"], order, 640)
        sizes = cut.groupBy("account", "_bkt").count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[1] == df.count() and sizes[0] <= 3 * 640, (factor, sizes)
        plain = df.groupBy("account", F.to_date("at")).count().agg(F.max("count")).first()[0]
        assert plain >= 10_000 * factor
    lo_hi = cut.groupBy("account", "_bkt").agg(F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi"))
    later = lo_hi.withColumn("before", F.lag("hi").over(W.partitionBy("account").orderBy("_bkt")))
    assert later.where(F.col("before") > F.col("lo")).count() == 0          # buckets follow the order


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_same_results_at_any_number_of_partitions(spark, events, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        order = [F.col(c) for c in ORDER]
        w = W.partitionBy("account").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        want = events.select("id", F.row_number().over(W.partitionBy("account").orderBy(*order)).cast("long").alias("n"), F.sum("d").over(w).alias("s"))
        got = scale.running(events, ["account"], F.to_date("at"), order, sums={"s": F.col("d")}, rank="n", split=640).select("id", "n", "s")
        assert got.exceptAll(want).count() == 0 and got.count() == events.count()
        grp = events.withColumn("g", F.sum(F.col("ok").cast("int")).over(w)).withColumn("last", F.max(F.when(F.col("ok"), F.unix_micros("at"))).over(w))
        run = W.partitionBy("account", "g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        want = grp.select("id", F.sum((~F.col("ok")).cast("long")).over(run).alias("r"), "last")
        got = scale.run_length(events, ["account"], F.to_date("at"), order, ~F.col("ok"), F.col("ok"), "r", split=640, since=(F.unix_micros("at"), "last"))
        assert got.select("id", "r", "last").exceptAll(want).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cuts_too_many_to_send(spark, events, monkeypatch):
    order = [F.col(c) for c in ORDER]
    plan = scale.split_hot(events.withColumn("_bkt", F.to_date("at")), ["account"], order, 640)
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString()
    small = scale.split_hot(events.limit(100).withColumn("_bkt", F.to_date("at")), ["account"], order, 640)
    assert "Join" not in small._jdf.queryExecution().toString()             # nothing hot, nothing joined
