"""Helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import scratch_path

#: Bytes of text that are split into words at once; longer texts are read in runs.
RUN_BYTES = 1 << 22
#: A table of at most so many rows of a few numbers each is small enough to broadcast.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table on shared storage: lineage is cut and later uses read columns only."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables on shared storage that are deleted when the work that reads them is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the tables. What a later result still reads must be written elsewhere."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        settings = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            place = hadoop(path)
            place.getFileSystem(settings).delete(place, True)
        self.paths.clear()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if a count proves that it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn from the MD5 digest of the parts, the same in any engine."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    head = F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus, F.lit(0))


def words(data: bytes) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space, of UTF-8 bytes."""
    return data.lower().split()


def word_runs(text: str | None, keep: int = 0) -> Iterator[list[bytes]]:
    """The words of a text in runs of bounded size; each run starts with the last ``keep``
    words of the run before it."""
    if not text:
        return
    data = text.encode()
    if len(data) <= RUN_BYTES:
        found = words(data)
        if found:
            yield found
        return
    carried: list[bytes] = []
    rest = b""
    for start in range(0, len(data), RUN_BYTES):
        piece = rest + data[start : start + RUN_BYTES]
        if start + RUN_BYTES < len(data):
            cut = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            rest, piece = piece[cut + 1 :], piece[: cut + 1]
        found = carried + words(piece)
        if len(found) > len(carried):
            yield found
            carried = found[-keep:] if keep else []


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for compiled tokenizers."""
    return vars(sys).setdefault("_tesserae_worker_cache", {})
