"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from dunlin.schemas import TABLES


def get_spark(app: str = "dunlin", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; on a cluster the caller passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DUNLIN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table with its declared schema: no inference, instants read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the JVM does not compile methods beyond this size, so a fused stage that large would be interpreted
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder; on a local master, where all share
    one machine, a temporary one if none is set.  Elsewhere a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("dunlin.test.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.conf.set("dunlin.test.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write an intermediate result as parquet in the shared folder and read it back.

    Used where several jobs read the same result: the files are columnar, so later jobs still get
    column pruning and pushed filters, and no executor memory is pinned.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows for work that is heavier than reading: dealt out anew if the scan has fewer parts than there are cores
    (one row group is one part), and as they come otherwise.  With ``rows``, always dealt out, into parts of at most about so many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        return df.repartition(max(2 * cores, -(-df.count() // rows)))
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, source_dir: str, name: str, build) -> DataFrame:
    """A stage's output table: written once per application and input folder, then read by every
    query that starts from it (columnar, so each reads only its own columns)."""
    key = (spark.sparkContext.applicationId, source_dir, name)
    if key not in _STAGED:
        _STAGED[key] = materialise(build(), name, "zstd")
    return _STAGED[key]
