"""A keyed table that batches are merged into, at a cost that depends on the batch only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import require_empty, stable

BUCKETS = 64
#: In a bucket with more versions than this, all but the newest are merged.
KEEP_VERSIONS = 4
#: Where a batch touches more buckets than this, the folders are found by listing the table.
NAMED_BUCKETS = 2_000


def newest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``.

    A plain aggregation: a key that arrives very often is reduced before the shuffle.
    """
    values = [column for column in rows.columns if column not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def conflicting_payloads(
    old: DataFrame, batch: DataFrame, keys: Sequence[str], payload: str
) -> DataFrame:
    """Keys that already have another payload; an error where payloads are receipts."""
    before = old.select(*keys, F.col(payload).alias("_before")).distinct()
    return batch.join(before, list(keys)).filter(~F.col(payload).eqNullSafe(F.col("_before")))


class KeyedStore:
    """The newest row per key, as a log in folders ``bucket=<b>/version=<n>``.

    A key always falls into the same bucket. A batch is one version: it writes its rows, reads
    only the buckets of its keys (for receipts), and merges those of them that have many versions.
    So its cost is bounded by the buckets it touches, not by the table; choose ``buckets`` so that
    one bucket is a small file, and use ``rebucket`` when the table has outgrown them. A batch that
    is written again replaces itself. The last row by ``order`` counts, and with ``late_wins`` that of
    the latest batch, whatever its order.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: Sequence[str],
        order: str,
        buckets: int = BUCKETS,
        keep_versions: int = KEEP_VERSIONS,
        late_wins: bool = True,
    ):
        self.spark, self.root, self.keys, self.order = spark, root, list(keys), order
        self.buckets, self.keep_versions = buckets, keep_versions
        self.by = ["version", order] if late_wins else [order]

    def _path(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        files, place = self._path(path)
        return files.exists(place)

    def versions(self, bucket: int) -> list[int]:
        files, place = self._path(f"{self.root}/bucket={bucket}")
        if not files.exists(place):
            return []
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return sorted(int(name.split("=")[1]) for name in names if name.startswith("version="))

    def bucket_of(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """All rows of the log with ``bucket`` and ``version``, of some buckets or of all; None if there
        are none."""
        if not self._exists(self.root):
            return None
        reader = self.spark.read.option("basePath", self.root)
        if buckets is None or len(buckets) > NAMED_BUCKETS:
            rows = reader.parquet(self.root)
            return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))
        paths = [path for b in buckets if self._exists(path := f"{self.root}/bucket={b}")]
        return reader.parquet(*paths) if paths else None

    def current(self) -> DataFrame:
        """The table after all batches."""
        rows = self.read()
        if rows is None:
            raise ValueError(f"{self.root} is empty")
        return newest_rows(rows, self.keys, self.by).drop("version", "bucket")

    def _write(self, rows: DataFrame) -> None:
        parts = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        parts.partitionBy("bucket", "version").parquet(self.root)

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(row.bucket for row in rows.select("bucket").distinct().collect())

    def upsert(self, batch: DataFrame, version: int, receipt: str | None = None) -> None:
        """Merge a batch; with ``receipt`` a key's other value of that column is an error."""
        rows = stable(batch.withColumn("bucket", self.bucket_of()))
        touched = self.touched(rows)
        if not touched:
            return
        if receipt is not None:
            within = rows.groupBy(*self.keys).agg(F.min(receipt).alias("_low"), F.max(receipt).alias("_high"))
            require_empty(within.filter("_low <> _high"), "changed receipt")
            known = self.read(touched)
            if known is not None:
                before = known.filter(F.col("version") != version)
                require_empty(conflicting_payloads(before, rows, self.keys, receipt), "changed receipt")
        newest = newest_rows(rows, [*self.keys, "bucket"], [self.order])
        self._write(newest.withColumn("version", F.lit(version).cast("bigint")))
        self.compact([b for b in touched if len(self.versions(b)) > self.keep_versions], version)

    def compact(self, buckets: Sequence[int], below: int) -> None:
        """Merge each bucket's versions under ``below`` into the last of them.

        The batch ``below`` may still come again and replaces its version, so that one stays as it is.
        The merged rows are written first, then the earlier versions deleted; in between both give
        the same newest rows.
        """
        last = {b: older[-1] for b in buckets if len(older := [v for v in self.versions(b) if v < below]) > 1}
        buckets = sorted(last)
        if not buckets:
            return
        rows = self.read(buckets).filter(F.col("version") < below)
        merged = stable(newest_rows(rows, [*self.keys, "bucket"], self.by).drop("version"))
        pairs = F.create_map(*[F.lit(x) for b in buckets for x in (b, last[b])])
        self._write(merged.withColumn("version", pairs[F.col("bucket")].cast("bigint")))
        for b in buckets:
            for version in [v for v in self.versions(b) if v < last[b]]:
                files, place = self._path(f"{self.root}/bucket={b}/version={version}")
                files.delete(place, True)

    def rebucket(self, root: str, buckets: int) -> KeyedStore:
        """The table in another folder with another number of buckets."""
        grown = KeyedStore(self.spark, root, self.keys, self.order, buckets, self.keep_versions, "version" in self.by)
        rows = newest_rows(self.read(), self.keys, self.by).drop("bucket")
        grown._write(rows.withColumn("bucket", grown.bucket_of()))
        return grown
