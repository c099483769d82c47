"""Content-addressed reuse of finished work.

``ObservationCache`` keeps the observations of whole images (one row per region) together with an
inventory, one row per image, that says what they were made of and what they must look like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.digest import digest
from tesserae.functions.text import json_list, json_object, json_or_null, json_string, json_value
from tesserae.runtime import stable


def cache_key(df: DataFrame, columns: Sequence[str], name: str = "cache_key") -> DataFrame:
    """Add the digest of the canonical JSON object over ``columns``.

    Plain values enter as their text, containers with their form.
    """
    fields = {}
    for column in columns:
        kind = df.schema[column].dataType
        nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        plain = json_or_null(F.col(column).cast("string"))
        fields[column] = json_value(F.col(column), kind) if nested else plain
    return df.withColumn(name, digest(json_object(**fields)))


def with_cache(
    inputs: DataFrame,
    cache: DataFrame,
    key_columns: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(value of every input, new cache entries).

    ``cache`` is (cache_key, value). Work is done once per distinct missing key: equal
    inputs share their result.
    """
    keyed = cache_key(inputs, key_columns)
    misses = keyed.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    # Kept at once: the caller appends what the result was made of.
    fresh = stable(compute(misses).select("cache_key", "value"))
    hits = cache.select("cache_key", "value", F.lit(True).alias("hit"))
    known = hits.unionByName(fresh.withColumn("hit", F.lit(False)))
    return keyed.join(known, "cache_key"), fresh


_ENTRIES = "cache_key string, region_id string, value string"
_INVENTORY = (
    "image_id string, cache_key string, path string, image_sha256 string, regions bigint, "
    "value_bytes bigint, content_sha256 string"
)


class ObservationCache:
    """Observations by key below ``root``: folders ``batch=<n>`` of entries and of inventory rows.

    Work that is stored is verified before it is used again: the number of its regions and the digest of
    its values must be those of the inventory. What does not match, or lacks one of both, counts as
    missing, is computed again and replaces the old entry by a later batch. Nothing is
    changed in place, so a batch that breaks off leaves what was there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _batches(self) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/inventory")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return []
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return sorted(int(name.split("=")[1]) for name in names if name.startswith("batch="))

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self._batches():
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.root}/{kind}")

    def inventory(self) -> DataFrame:
        """The latest inventory row of every key."""
        rows = self._read("inventory", _INVENTORY)
        names = [c for c in rows.columns if c != "cache_key"]
        last = rows.groupBy("cache_key").agg(F.max_by(F.struct(*names), "batch").alias("_row"))
        return last.select("_row.image_id", "cache_key", *[f"_row.{c}" for c in names if c != "image_id"])

    def entries(self) -> DataFrame:
        """The entries that the inventory's batches wrote."""
        kept = self.inventory().select("cache_key", "batch")
        return self._read("entries", _ENTRIES).join(kept, ["cache_key", "batch"])

    def _digests(self, entries: DataFrame) -> DataFrame:
        """(cache_key, regions, value_bytes, content_sha256), for any order of entries.

        Digests of a key's regions meet in 256 parts by their first digits, and these in one.
        """
        text = json_list(json_string(F.col("region_id")), json_or_null(F.col("value")))
        rows = entries.select("cache_key", F.length(F.encode("value", "utf-8")).alias("b"), F.sha2(text, 256).alias("h"))
        joined = lambda name: F.array_join(F.array_sort(F.collect_list(name)), "")
        parts = rows.groupBy("cache_key", F.substring("h", 1, 2).alias("p")).agg(
            F.count("*").alias("n"), F.sum("b").alias("b"), F.sha2(joined("h"), 256).alias("h")
        )
        return parts.groupBy("cache_key").agg(
            F.sum("n").alias("regions"), F.coalesce(F.sum("b"), F.lit(0)).alias("value_bytes"),
            F.sha2(joined("h"), 256).alias("content_sha256"),
        )

    def verified(self) -> DataFrame:
        """(cache_key, ok) of every key of the inventory."""
        names = ("regions", "value_bytes", "content_sha256")
        found = self._digests(self.entries()).select("cache_key", *[F.col(n).alias(f"_{n}") for n in names])
        same = F.col("content_sha256").eqNullSafe(F.col("_content_sha256"))
        for n in ("regions", "value_bytes"):
            same = same & (F.col(n) == F.coalesce(f"_{n}", F.lit(0)))
        return self.inventory().join(found, "cache_key", "left").select("cache_key", same.alias("ok"))

    def observe(
        self,
        images: DataFrame,
        key_columns: Sequence[str],
        compute: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """(image_id, cache_key, state) of ``images`` (image_id, path, image_sha256, ...): state is hit,
        computed, or recomputed where a stored entry did not match.

        ``compute`` maps the images that are missing, one per key, to (cache_key, region_id, value).
        """
        keyed = stable(cache_key(images, key_columns))
        checked = stable(self.verified())
        missing = keyed.join(checked.filter("ok"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
        if missing.take(1):
            batch = 1 + max(self._batches(), default=0)
            fresh = compute(missing).select("cache_key", "region_id", "value")
            fresh.write.mode("overwrite").parquet(f"{self.root}/entries/batch={batch}")
            written = self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/entries/batch={batch}")
            facts = missing.select("image_id", "cache_key", "path", "image_sha256")
            rows = facts.join(self._digests(written), "cache_key", "left").withColumns(
                {"regions": F.coalesce("regions", F.lit(0)), "value_bytes": F.coalesce("value_bytes", F.lit(0))}
            )
            names = [field.split(" ")[0] for field in _INVENTORY.split(", ")]
            rows.select(*names).write.mode("overwrite").parquet(f"{self.root}/inventory/batch={batch}")
        state = F.when(F.col("ok"), "hit").when(F.col("ok").isNull(), "computed").otherwise("recomputed")
        return keyed.join(checked, "cache_key", "left").select("image_id", "cache_key", state.alias("state"))
