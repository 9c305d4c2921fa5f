"""The table of the price search is as many parts as it has work for, and a task gives each cell once."""

import numpy as np
from pyspark.sql import functions as F

from dunlin import dims
from dunlin.operators import allocation as L


def _table(spark, n):
    values = [F.lit(0.0) if a == "do_nothing" else F.when(F.xxhash64("id", F.lit(a)) % 3 != 0, (F.abs(F.xxhash64("id", F.lit(a), F.lit(1))) % 9_000_000).cast("double")) for a in dims.ACTION_NAMES]
    return spark.range(n, numPartitions=1).select(F.col("id").cast("string").alias("subject_token"), F.inline(F.array(*[
        F.struct(F.lit(a).alias("action"), v.alias("value")) for a, v in zip(dims.ACTION_NAMES, values)]))).where("value is not null")


def test_parts_follow_the_subjects_and_cells_come_once(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 500)
    table = L.compact(_table(spark, 3000))
    assert table.rdd.getNumPartitions() > 1 and table.count() == 3000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        one = table.coalesce(1)
        rows = L._histogram(one, "contact", {}, -1)
        assert len(rows) == len({(r["c"], r["f"]) for r in rows})
        price = L.price_of(table, "contact", 400, {})
        hinted = L.price_of(table, "contact", 400, {}, int(round(price / L.DELTA)) // L.COARSE)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert price == hinted > 0
    v = table.toPandas()
    best = lambda on: np.nanmax(np.array([v[f"v_{a}"].fillna(-np.inf) for a in dims.ACTION_NAMES if (L._COST[a]["contact"] > 0) == on]), axis=0)
    gain = np.sort(best(True) - best(False))[::-1]
    steps = lambda p: int((np.ceil(gain / L.DELTA) > round(p / L.DELTA)).sum())
    assert steps(price) <= 400 < steps(price - L.DELTA)
