"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Settings a rollup job should run with (applied by :func:`local_session` and
# :func:`configure`): UTC session time so timestamp_ntz round-trips, AQE for
# runtime coalescing, broadcast conversion and skew-join splitting.  Skew
# splitting is forced even where it costs an extra shuffle: some joins here
# (the soft-credit join of C5) feed an aggregation on their own key, and
# without the force AQE would leave a hot donation's partition to one task.
# Rows here are narrow numbers that shrink to a twentieth in a shuffle: a task that gets 64 MB of
# them (Spark's default) sorts and hashes over a gigabyte, so tasks and splits are cut smaller.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.unionOutputPartitioning": "true",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in CONF.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "kinsum") -> SparkSession:
    """A local session for tests and the bench (UI off, no server started)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only when it is unset
    and the session is local (tests) a fresh temporary folder is created and registered;
    on a cluster that folder would be another one on each machine and after each start,
    so an unset folder is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinsum-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it ends.  Spark else keeps them until the driver
    happens to collect its garbage, so those of all the steps of a job lie on the disks together.
    Only for writes and for frames that are run once: a second run of the same frame would miss them."""
    old = spark.conf.get(_DROP, "false")
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, old)


def store_parquet(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write a table that the library reads again: zstd, and no shuffle files are left behind."""
    with shuffles_dropped(spark):
        writer.option("compression", "zstd").parquet(path)


def drop_parquet(spark: SparkSession, path: str) -> None:
    """Delete a table of the library's own that is not read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: it is computed once
    for all that read it, and later stages start from its files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kinsum/{name}-{uuid.uuid4().hex}"
    store_parquet(df.write, spark, path)
    return spark.read.schema(df.schema).parquet(path)
