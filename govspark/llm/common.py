"""Helpers that several operators share: words, scratch tables, exact radix selection."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _LETTERS, _LETTERS.lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a scratch one only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs no recomputation beyond one step.

    ``write`` stores a step and reads it back; its shuffle files go as soon as the table is there, so that the disk
    holds one step at a time. ``drop`` removes a table that nothing lazy reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a side that meets its own relatives."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def collision_free(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that none of ``columns`` has (case aside)."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a text whose code points are at most U+00FF, bit by bit of its UTF-8 bytes."""
    code = "CAST(unicode(c) AS BIGINT)"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + {code} // 64, 128 + {code} % 64] END))"
    bits = f"flatten(list_transform({octets}, lambda b: [(b >> k) & 1 for k in range(8)]))"
    step = "lambda x, b: xor(x >> 1, CASE WHEN xor(x & 1, b) = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), {step}), 4294967295)"
