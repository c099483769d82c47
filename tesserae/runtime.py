"""Session helpers: table reading, shared storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tesserae-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage so that a lost executor cannot change it.

    This is a written table and not a checkpoint, because a checkpoint keeps the size that was
    estimated for its plan. Estimates of joins are products, so over rounds that read each other's
    checkpoints they grow into numbers that planning spends minutes on; a file has its true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stable")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require_empty(bad: DataFrame, message: str) -> None:
    """Strict mode: fail with one example when ``bad`` has any row."""
    example = bad.take(1)
    if example:
        raise ValueError(f"{message}: {example[0].asDict(recursive=True)}")
