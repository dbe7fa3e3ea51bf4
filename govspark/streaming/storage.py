"""Batch-addressed Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None before its first row; a table that is there but can't be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def overwrite_batch(df: DataFrame, path: str, batch_id: int, partitions: list[str] | None = None) -> None:
    """Write the rows of one batch and replace whatever that batch wrote before."""
    if partitions is None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id")
        .parquet(path)
    )
