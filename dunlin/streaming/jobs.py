"""Structured Streaming jobs.

Every job reads a file stream, keeps its state in the state store or in a small versioned table, writes
through ``foreachBatch`` or a file sink with its own checkpoint folder, and survives the loss of any executor.  A job
that is given its checkpoint folder again goes on where it stopped (``drain``).  ``availableNow`` drains what is there;
a service would use a processing-time trigger with the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.functions import times
from dunlin.operators import breaker, diagnosis, ingest, scale
from dunlin.session import scratch_path
from dunlin.streaming import keyed

LATE = "30 days"


def land(df: DataFrame, label: str, order: str, files: int = 4) -> str:
    """Write a table as a few time-ordered files: the landing folder of a stream."""
    path = scratch_path(df.sparkSession, label)
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    return path


def land_in_order(df: DataFrame, label: str, order: str, files: int) -> str:
    """Landing folder whose files arrive one after the other in time order, as a source would send them."""
    path = scratch_path(df.sparkSession, label)
    x = df.withColumn("_us", F.unix_micros(order))
    cuts = [None, *scale.cut_points(x, "_us", files), None]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = x if lo is None else x.filter(F.col("_us") >= lo)
        part = part if hi is None else part.filter(F.col("_us") < hi)
        part.drop("_us").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 2) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Bytes of a micro-batch that is cut by size.
BATCH_BYTES = 512 << 20


def stream_by_size(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over what another stream wrote: that is a file for each of its tasks, so batches are cut by bytes, for
    a key costs its state once in every batch that touches it."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", path: str | None = None, state: str | None = None) -> None:
    """Run the stream until its input is consumed.

    `state` names the stream's checkpoint folder: a run with the folder of an earlier one goes on where that stopped,
    and repeats the batch that was not finished.  Without it the stream starts over."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", state or scratch_path(spark, "stream-state")).trigger(availableNow=True)
    provider = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)          # read when the stream starts
    try:
        q = (w.foreachBatch(each) if each else w.format("parquet").option("path", path)).start()
    finally:
        spark.conf.set(keyed.PROVIDER, provider)
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a replayed batch overwrites itself
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch int").parquet(path)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted version of each updated key."""
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def updates(df: DataFrame, keys: list[str], label: str, state: str | None = None) -> DataFrame:
    """Drain an update-mode aggregation and return the final row of each key."""
    path = scratch_path(df.sparkSession, label)
    drain(df, append_to(path), mode="update", state=state)
    return latest(read_back(df.sparkSession, path, df.schema), keys)


def continuous_ingest(deliveries: DataFrame, secrets: dict[str, bytes], out: str) -> None:
    """Archive everything, parse what is admissible, put the rest in quarantine."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = ingest.classify(batch, secrets)
        stage = f"{out}/stage/batch={batch_id}"
        rows.write.mode("overwrite").parquet(stage)           # parsed once, read three times below
        rows = batch.sparkSession.read.schema(rows.schema).parquet(stage)
        rows.select("archive_id", "source", "raw", "signature", "received_at").write.mode("overwrite").parquet(f"{out}/archive/batch={batch_id}")
        good = rows.filter(F.col("verdict") == "accepted").select("archive_id", "source", "event.event_id", "event.event_ts", "event.kind", "event.rail", "event.account_ref", "event.amount_paise", "event.succeeded")
        good.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        rows.filter(F.col("verdict") != "accepted").select("archive_id", "source", "verdict").write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
    drain(deliveries, each)


def dedupe(events: DataFrame) -> DataFrame:
    return events.withWatermark("event_ts", LATE).dropDuplicatesWithinWatermark(["source", "event_id"])


def decline_windows(presentations: DataFrame) -> DataFrame:
    """The four grains as one stateful aggregation.  The one-day window is a key that changes no group
    (every bucket lies within a day) and lets the watermark evict finished days from the state."""
    b = times.bucket(F.col("at_ts"), diagnosis.FINEST)
    x = presentations.withWatermark("at_ts", LATE).select("at_ts", "succeeded", F.inline(diagnosis.level_rows(F.col("issuer_ref"), F.col("rail"), b)))
    return x.groupBy(F.window("at_ts", "1 day"), "level", "key", "bucket").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("succeeded")).alias("declines"))


CELLS = "lvl_no int, level string, key string, bucket long, attempts long, declines long"


def online_cells(presentations: DataFrame, out: str, state: str | None = None) -> Callable[[], DataFrame]:
    """Keep the cell table up to date per micro-batch; baselines are recomputed from the bucket list.

    Each batch adds its cells to the version of the batch before and writes its own, named by its number: a batch that
    is run again writes the same rows anew, and a restarted job (with the same `out` and `state`) goes on from the last
    version."""
    spark = presentations.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        new = diagnosis.cohort_cells(batch)
        if batch_id:
            old = batch.sparkSession.read.schema(CELLS).parquet(f"{out}/cells/batch={batch_id - 1}")
            new = old.unionByName(new).groupBy("lvl_no", "level", "key", "bucket").agg(F.sum("attempts").alias("attempts"), F.sum("declines").alias("declines"))
        new.write.mode("overwrite").parquet(f"{out}/cells/batch={batch_id}")
    drain(presentations, each, state=state)

    def scored() -> DataFrame:
        every = spark.read.schema(CELLS + ", batch int").parquet(f"{out}/cells")
        newest = every.agg(F.max("batch")).first()[0]
        return diagnosis.baselines(every.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch"))
    return scored


def source_breaker(events: DataFrame, out: str, threshold: int = 20, cooldown_s: int = 300, state: str | None = None) -> DataFrame:
    """Trips per source, from events that arrive in time order: so many consecutive failures open a breaker, arrivals
    during the cool-down are not counted, and the first success after it closes the breaker.

    A source of any size is cut along time within each micro-batch (:mod:`dunlin.operators.breaker`).  What is carried
    is one row for each source in `out`/state, one version for each batch: a batch that is run again reads the version
    before it and writes its own anew, so a job that is killed goes on from its checkpoint with the same rows."""
    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        carried = own.read.schema(breaker.STATE).parquet(f"{out}/state/batch={batch_id - 1}") if batch_id else None
        x = batch.select("source", "event_id", F.unix_micros("at_ts").alias("at_us"), "succeeded")
        trips, after = breaker.breaker_trips(x, threshold, cooldown_s * 1_000_000, carried)
        trips.write.mode("overwrite").parquet(f"{out}/trips/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
    drain(events, each, state=state)
    return events.sparkSession.read.schema("source string, tripped_us long, batch int").parquet(f"{out}/trips").select("source", "tripped_us")


def promise_tracker(promises: DataFrame, payments: DataFrame, grace_hours: int = 36, longest_days: int = 31) -> DataFrame:
    """Payments by each promise's own deadline; a promise without one comes out with NULL once the watermark
    passes it.  ``longest_days`` is the longest term of a promise: it bounds the state that the join keeps, and a promise
    with a longer term stops the stream, for a payment within its own deadline would be lost in silence."""
    deadline = F.col("due_at") + F.expr(f"interval {grace_hours} hours")
    longer = F.raise_error(F.concat(F.lit(f"a promise runs longer than {longest_days} days: claim "), F.col("claim_no").cast("string"))).cast("timestamp")
    p = promises.withWatermark("made_at", "1 day").withColumn("deadline", F.when(deadline > F.col("made_at") + F.expr(f"interval {longest_days} days"), longer).otherwise(deadline))
    q = payments.withColumnRenamed("claim_no", "paid_claim").withWatermark("paid_at", "1 day")
    cond = F.expr("claim_no = paid_claim and paid_at >= made_at and paid_at <= due_at + interval {0} hours and paid_at <= made_at + interval {1} days".format(grace_hours, longest_days))
    return p.join(q, cond, "leftOuter").select("claim_no", "made_at", "deadline", "paid_at")
