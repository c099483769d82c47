"""Checksummed manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import json_object, json_string, json_value
from tesserae.operators.sets import find_duplicates
from tesserae.runtime import require_empty

# Digest tree: rows meet in leaves named by the first digits of their own digest, leaves in
# nodes, nodes in the root. Digests spread evenly, so a leaf stays small at any size.
LEAF_DIGITS = 5
NODE_DIGITS = 2


def sample_json(df: DataFrame) -> Column:
    """Canonical JSON object of a sample row; options become an object in label order."""
    fields: dict[str, Column] = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        column = F.col(field.name)
        if kind.startswith("array<struct<label"):
            pairs = F.transform(
                F.array_sort(column),
                lambda entry: F.concat(json_string(entry.label), F.lit(": "), json_string(entry.text)),
            )
            fields[field.name] = F.coalesce(
                F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), F.lit("null")
            )
        else:
            fields[field.name] = json_value(column, field.dataType)
    return json_object(**fields)


def _fold(parts: DataFrame, digits: int, keys: Sequence[str] = ()) -> DataFrame:
    """Digest of the sorted member digests of every part name's first ``digits``, per ``keys``."""
    members = F.array_sort(F.collect_list(F.struct("part", "digest")))
    joined = F.array_join(F.transform(members, lambda member: member["digest"]), "")
    return (
        parts.withColumn("_name", F.substring("part", 1, digits))
        .groupBy(*keys, "_name")
        .agg(F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
        .withColumnRenamed("_name", "part")
    )


def row_digests(df: DataFrame, id_column: str = "sample_id") -> DataFrame:
    digest = F.sha2(sample_json(df), 256)
    return df.select(F.col(id_column), digest.alias("digest"))


def manifest_digest(df: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """One row (rows, digest): the root of a digest tree, the same for any row order."""
    parts = row_digests(df, id_column).select(
        F.col("digest").alias("part"), F.lit(1).cast("bigint").alias("rows"), "digest"
    )
    for digits in (LEAF_DIGITS, NODE_DIGITS, 0):
        parts = _fold(parts, digits)
    return parts.select("rows", "digest")


def shard_digests(df: DataFrame, shard: str, id_column: str = "sample_id") -> DataFrame:
    """(shard, rows, digest): the root of each shard's own digest tree, without the shard column."""
    digest = F.sha2(sample_json(df.drop(shard)), 256)
    parts = df.select(shard, digest.alias("part"), F.lit(1).cast("bigint").alias("rows"), digest.alias("digest"))
    for digits in (LEAF_DIGITS, NODE_DIGITS, 0):
        parts = _fold(parts, digits, [shard])
    return parts.select(shard, "rows", "digest")


def write_manifest(df: DataFrame, path: str, **metadata: str) -> None:
    """Write samples and a one-row header with their digest; ids must be unique.

    The input is evaluated once, for the write; without a header the samples are no manifest.
    """
    df.write.mode("errorifexists").parquet(f"{path}/samples")
    written = df.sparkSession.read.parquet(f"{path}/samples")
    require_empty(find_duplicates(written.select("sample_id"), ["sample_id"]), "repeated sample id")
    header = manifest_digest(written)
    if not header.take(1):
        raise ValueError("empty manifest")
    for name, value in {"schema_version": "1", **metadata}.items():
        header = header.withColumn(name, F.lit(value))
    header.write.mode("errorifexists").json(f"{path}/header")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples after checking that they are unchanged, not empty and unique."""
    samples = spark.read.parquet(f"{path}/samples")
    stored = spark.read.json(f"{path}/header").first()
    found = manifest_digest(samples).first()
    if found is None or found["digest"] != stored["digest"]:
        raise ValueError("manifest contents do not match their digest")
    require_empty(find_duplicates(samples, ["sample_id"]), "repeated sample id")
    return samples


def combined_digest(headers: DataFrame) -> DataFrame:
    """One row (shards, rows, combined): the digest over all shards' digests in order of shard."""
    roots = F.array_sort(F.collect_list(F.struct("shard", "digest")))
    joined = F.array_join(F.transform(roots, lambda root: root["digest"]), "")
    return headers.agg(F.count("*").alias("shards"), F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("combined"))


def write_shard_manifests(df: DataFrame, path: str, parent: str, shard: str = "shard") -> DataFrame:
    """Write the shards of a manifest, each with a header that ties it to its parent; returns the
    headers (shard, shard_count, rows, digest, parent_digest, combined).

    ``df`` is the parent's samples with their shard, ``parent`` the path of a written manifest. The shards
    must hold exactly the parent's samples: their digest without the shard is the parent's. ``combined``
    is over the digests of all shards, so no shard can be exchanged alone.
    """
    spark = df.sparkSession
    stored = spark.read.json(f"{parent}/header").first()
    df.write.mode("errorifexists").partitionBy(shard).parquet(f"{path}/samples")
    written = spark.read.schema(df.schema).parquet(f"{path}/samples")
    found = manifest_digest(written.drop(shard)).first()
    if found is None or found["digest"] != stored["digest"]:
        raise ValueError("shards do not hold the samples of their parent")
    headers = shard_digests(written, shard).withColumnRenamed(shard, "shard")
    total = combined_digest(headers).select(F.col("shards").alias("shard_count"), "combined")
    headers = headers.crossJoin(F.broadcast(total)).withColumn("parent_digest", F.lit(stored["digest"]))
    headers.write.mode("errorifexists").json(f"{path}/headers")
    return read_shard_headers(spark, path)


_HEADER = "shard bigint, shard_count bigint, rows bigint, digest string, parent_digest string, combined string"


def read_shard_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers, after checking that all shards of one parent are there and belong together."""
    headers = spark.read.schema(_HEADER).json(f"{path}/headers")
    found = combined_digest(headers).first()
    agreed = headers.select("shard_count", "parent_digest", "combined").distinct().limit(2).collect()
    if len(agreed) != 1 or agreed[0].shard_count != found.shards or agreed[0].combined != found.combined:
        raise ValueError("shard headers do not belong together")
    return headers


def read_shard(spark: SparkSession, path: str, shard: int, parent_digest: str, name: str = "shard") -> DataFrame:
    """Samples of one shard, after checking its header, its parent and its content."""
    header = read_shard_headers(spark, path).filter(F.col("shard") == shard).first()
    if header is None:
        raise ValueError(f"no shard {shard}")
    if header.parent_digest != parent_digest:
        raise ValueError("shard of another manifest")
    samples = spark.read.parquet(f"{path}/samples").filter(F.col(name) == shard)
    found = shard_digests(samples, name).first()
    if found is None or found["digest"] != header.digest or found["rows"] != header.rows:
        raise ValueError("shard contents do not match their digest")
    return samples.drop(name)
