"""Session defaults and the two cluster services the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators assume. Joins carry no broadcast hints: Spark
# itself broadcasts a side only when its measured size is below
# spark.sql.autoBroadcastJoinThreshold, and splits skewed partitions otherwise.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app_name: str = "govspark", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small test data is still worth all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        # Call-site capture costs several JVM round trips per Column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a scratch one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="govspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


# Spark's own setting to remove the shuffle files of an execution when it ends.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: WeakSet[DataFrame] = WeakSet()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside remove their shuffle files at their end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the checkpoint folder; a table written here before is returned as it is.

    A lost executor costs no recomputation, and unlike a checkpointed RDD the table has a measured size,
    by which Spark decides whether it may be broadcast, and columns that can be read one by one. Nothing reads the
    shuffles of the write again, so they leave the disk with it.
    """
    if df in _WRITTEN:
        return df
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/govspark-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.add(written)
    return written
