"""Batches of a stream over another stream's files follow their bytes, not how many tasks wrote them."""

from dunlin.session import scratch_path
from dunlin.streaming import jobs as J


def test_many_small_files_are_one_batch(spark, monkeypatch):
    path, seen = scratch_path(spark, "small"), []
    rows = spark.range(400, numPartitions=20)
    rows.write.parquet(path)
    J.drain(J.stream_by_size(spark, path, rows.schema), lambda batch, n: seen.append(batch.count()))
    assert seen == [400]
    monkeypatch.setattr(J, "BATCH_BYTES", 1)
    seen.clear()
    J.drain(J.stream_by_size(spark, path, rows.schema), lambda batch, n: seen.append(batch.count()))
    assert len(seen) > 1 and sum(seen) == 400


def test_the_account_state_reads_by_size(spark, monkeypatch):
    from dunlin.plans import q_streaming as Q
    used = []
    real = J.stream_by_size
    monkeypatch.setattr(J, "stream_by_size", lambda *a: used.append(a[1]) or real(*a))
    assert Q.r04(spark, "/root/testdata/sf0.001").count() > 0 and len(used) == 1
