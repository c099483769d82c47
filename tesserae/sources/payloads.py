"""Payloads of wanted keys out of large Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import require_empty, stable
from tesserae.sources.files import base_name, unsafe_or_ambiguous

#: A table of at most so many keys goes to every task; beyond that both sides are exchanged.
BROADCAST_KEYS = 200_000
STORE = "key string, name string, sha256 string, size bigint, content binary"


def mapping_of(rows: DataFrame, name: str, original: str, prefix: str) -> DataFrame:
    """(key, name, original) of the rows whose original lies below ``prefix``: the key is the
    original's file name. A key for two images, or a name with a folder, is an error."""
    inside = rows.filter(F.startswith(F.col(original), F.lit(prefix.rstrip("/") + "/")))
    mapping = inside.select(
        base_name(F.col(original)).alias("key"), F.col(name).alias("name"), F.col(original).alias("original")
    ).distinct()
    require_empty(unsafe_or_ambiguous(mapping, "key"), "unsafe or ambiguous original name")
    return mapping


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The payloads that a store has, with their key."""
    return spark.read.schema(STORE + ", batch string").parquet(store)


def _near(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast hint if a count proves that they are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _key_column(key: str, as_base_name: bool) -> Column:
    return base_name(F.col(key)) if as_base_name else F.col(key)


def key_counts(tables: DataFrame, mapping: DataFrame, key: str = "filename", as_base_name: bool = False) -> DataFrame:
    """(key, rows, least, most) of the wanted keys; reads the key column only. ``least`` and ``most``
    are the column's values, which bound the second scan."""
    keys = tables.select(_key_column(key, as_base_name).alias("key"), F.col(key).alias("_value"))
    hits = keys.join(_near(mapping.select("key").distinct()), "key", "left_semi")
    return hits.groupBy("key").agg(
        F.count("*").alias("rows"), F.min("_value").alias("least"), F.max("_value").alias("most")
    )


def payload_rows(
    tables: DataFrame, wanted: DataFrame, key: str, payload: str, as_base_name: bool = False
) -> DataFrame:
    """(key, name, content) of the wanted keys (key, name, least, most). Only the key and the payload
    are read, of row groups whose range of key values can hold a wanted one."""
    bounds = wanted.agg(F.min("least"), F.max("most")).first()
    rows = tables
    if bounds[0] is not None:
        rows = tables.filter((F.col(key) >= bounds[0]) & (F.col(key) <= bounds[1]))
    picked = rows.select(_key_column(key, as_base_name).alias("key"), F.col(payload).cast("binary").alias("content"))
    return picked.join(_near(wanted.select("key", "name")), "key")


def restore_payloads(
    spark: SparkSession,
    paths: Sequence[str],
    mapping: DataFrame,
    store: str,
    present: DataFrame | None = None,
    key: str = "filename",
    payload: str = "image.bytes",
    as_base_name: bool = False,
    strict: bool = True,
    batch: str = "0",
) -> DataFrame:
    """Copy the payloads of the mapped keys into ``store``; returns what happened to every key.

    ``mapping`` is (key, name, original), ``present`` (name) needs no copy. The key may be a
    nested field, such as ``image.path``, of which the file name counts (``as_base_name``). The
    report is (key, name, original, status, sha256, size) with status restored,
    already_present, missing, duplicate or empty; with ``strict`` duplicates and empty payloads
    are errors, before anything is written for the former. A batch that is written again
    replaces itself.
    """
    tables = spark.read.parquet(*paths)
    counts = stable(key_counts(tables, mapping, key, as_base_name))
    if strict:
        require_empty(counts.filter("rows > 1"), "duplicate original in the tables")
    here = mapping.select("key").limit(0).select(F.col("key").alias("name"))
    here = (here if present is None else present.select("name").distinct()).withColumn("_here", F.lit(True))
    known = stable(mapping.join(counts, "key", "left").join(here, "name", "left"))
    wanted = known.filter("rows = 1 AND _here IS NULL")
    rows = payload_rows(tables, wanted, key, payload, as_base_name).select(
        "key", "name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size"), "content"
    )
    path = f"{store}/batch={batch}"
    rows.filter("size > 0").write.mode("overwrite").parquet(path)
    copied = spark.read.schema(STORE).parquet(path).select("key", "sha256", "size")
    status = (
        F.when(F.col("rows").isNull(), "missing")
        .when(F.col("rows") > 1, "duplicate")
        .when(F.col("_here").isNotNull(), "already_present")
        .when(F.col("sha256").isNull(), "empty")
        .otherwise("restored")
    )
    report = known.join(copied, "key", "left").select("key", "name", "original", status.alias("status"), "sha256", "size")
    if strict:
        require_empty(report.filter("status = 'empty'"), "no payload")
    return report
