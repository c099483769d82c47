"""Running profiles and idempotent upserts from files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.streaming.store import BUCKETS, KeyedStore


def result_stream(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(directory)


def stream_profile(
    arrivals: DataFrame, id_column: str, group: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Counts and sums per group, every id counted once; one table version per batch.

    The state of the first stage is one key per id, spread by its hash; the second keeps
    one row per group. Every batch replaces ``output`` with the full result so far.
    """
    profile = (
        arrivals.dropDuplicates([id_column])
        .groupBy(group)
        .agg(
            F.count("*").alias("calls"),
            F.sum("seconds").alias("seconds"),
            F.sum("output_tokens").alias("output_tokens"),
        )
    )

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/version={batch_id}")

    return (
        profile.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of a table whose every version is complete in itself.

    Folder names tell which one that is; no other version is read.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    listed = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = [status.getPath().getName() for status in listed]
    newest = max(int(name.split("=")[1]) for name in names if name.startswith("version="))
    return spark.read.parquet(f"{table}/version={newest}")


def read_current(
    spark: SparkSession, table: str, keys: Sequence[str], order: str, late_wins: bool = True
) -> DataFrame:
    """The table after all upserts: the newest row per key, later batches first."""
    return KeyedStore(spark, table, keys, order, late_wins=late_wins).current()


def stream_upsert(
    arrivals: DataFrame,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str,
    receipt: str | None = None,
    buckets: int = BUCKETS,
    late_wins: bool = True,
) -> StreamingQuery:
    """Merge every batch into the keyed table: batch ``n`` is its version ``n``.

    A batch's cost does not grow with the table, and a batch that runs again after a failure
    writes the same version once more.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        store = KeyedStore(batch.sparkSession, table, keys, order, buckets, late_wins=late_wins)
        store.upsert(batch, batch_id, receipt)

    return (
        arrivals.writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
