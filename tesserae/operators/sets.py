"""Duplicates, set comparison and incremental reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import require_empty


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def find_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to more than one value."""
    return (
        df.groupBy(key)
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        .filter(F.col("_low") != F.col("_high"))
        .select(key, F.col("_low").alias("first_value"), F.col("_high").alias("last_value"))
    )


def set_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with the side's name."""
    marked = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    both = marked.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.filter("_l + _r = 1").select(
        key, F.when(F.col("_l") == 1, "left").otherwise("right").alias("side")
    )


def same_set(left: DataFrame, right: DataFrame, key: str) -> bool:
    return not set_diff(left, right, key).take(1)


def merge_report(previous: DataFrame, current: DataFrame, present: DataFrame) -> DataFrame:
    """Restored images after a further pass, and the ones that were there before.

    ``previous`` and ``current`` have (name, source_digest, detail). Earlier entries count
    only under the same source digest; newer ones replace them. ``present`` (name) adds
    ``already_present`` rows for names that no pass has restored.
    """
    now = current.select("name", "source_digest", F.col("detail").alias("_new"))
    digests = current.select("source_digest").distinct()
    kept = previous.join(digests, "source_digest", "left_semi").select(
        "name", F.col("detail").alias("_old")
    )
    restored = (
        kept.join(now.select("name", "_new"), "name", "full")
        .select(
            "name",
            F.lit("restored").alias("status"),
            F.coalesce("_new", "_old").alias("detail"),
        )
    )
    already = present.join(restored, "name", "left_anti").select(
        "name", F.lit("already_present").alias("status"), F.lit(None).cast("string").alias("detail")
    )
    return restored.unionByName(already)


def assemble(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of all parts by column name, with the part they come from and who else has their key.

    ``origin`` names the part. ``conflict`` is null, or the sorted origins of a key that occurs more than
    once, with `` x n`` where one part has it n times. Columns that a part lacks are null.
    """
    rows = None
    for name, part in parts.items():
        named = part.withColumn("origin", F.lit(name))
        rows = named if rows is None else rows.unionByName(named, allowMissingColumns=True)
    counted = rows.groupBy(*keys, "origin").agg(F.count("*").alias("_n"))
    shown = F.concat("origin", F.when(F.col("_n") > 1, F.concat(F.lit(" x "), F.col("_n").cast("string"))).otherwise(""))
    # At most one entry per part and key.
    repeated = counted.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(shown)).alias("conflict"))
    repeated = repeated.filter("_rows > 1").drop("_rows")
    same = F.lit(True)
    renamed = repeated.select(*[F.col(k).alias(f"_{k}") for k in keys], "conflict")
    for k in keys:
        same = same & rows[k].eqNullSafe(renamed[f"_{k}"])
    return rows.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


def assembled(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The same, refusing a key that occurs more than once."""
    rows = assemble(parts, keys)
    require_empty(rows.filter("conflict IS NOT NULL").select(*keys, "conflict"), "repeated key")
    return rows.drop("conflict")
