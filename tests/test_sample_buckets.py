"""The sampling order keeps one bucket for a subject of few candidates, however far apart its claims are."""

from pyspark.sql import functions as F

from dunlin.operators import allocation as L
from dunlin.operators import scale


def test_far_claims_share_a_bucket_and_the_branch_is_the_first_over_the_draw(spark, monkeypatch):
    rows = [("sub_" + f"{s:032x}", (1 + c * 1_000_003) * 16, "retry", 0.15) for s in range(20) for c in range(6)]
    rows += [("sub_" + f"{s:032x}", L.NOTHING_ORD, "do_nothing", 0.1) for s in range(20)]
    dist = spark.createDataFrame(rows, "subject_token string, ord long, action string, p double")
    buckets, real = [], scale.running

    def spy(df, keys, bucket, order, **kw):
        buckets.append(df.select(*keys, bucket.alias("b")).distinct().count())
        return real(df, keys, bucket, order, **kw)
    monkeypatch.setattr(scale, "running", spy)
    got = {r["subject_token"]: r["ord"] for r in L.sample(dist, "s").collect()}
    assert buckets == [20]
    draws = {r["t"]: r["d"] for r in dist.select(F.col("subject_token").alias("t"), L.hashing.unit_draw(F.concat_ws(L.hashing.SEP, F.lit("s"), "subject_token")).alias("d")).distinct().collect()}
    for token, draw in draws.items():
        total, want = 0.0, L.NOTHING_ORD
        for _, o, _, p in sorted(r for r in rows if r[0] == token):
            total += p
            if total > draw:
                want = o
                break
        assert got[token] == want
