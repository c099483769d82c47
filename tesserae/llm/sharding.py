"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

A document's place is a 60-bit hash of its id. A directory of hash prefixes starts with the
empty prefix; a bucket whose documents exceed the byte limit splits on one more bit, others
stay. A bucket of a single document never splits: if that document alone exceeds the limit it
is a shard of its own, marked ``oversize``. Rows that share a whole hash (repeated ids) can't
be told apart by bits: such a bucket is cut into pages that fit the limit.

Nulls: a null text has 0 bytes and a null id hashes like the text ``null``. An empty table has
no shards. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small, written
from tesserae.operators.ranking import rank_in_groups

BITS = 60
LIMIT_BYTES = 1 << 20
#: Levels below the even depth that one histogram covers, before a deeper one is made for
#: what is still too large.
SPARE_LEVELS = 4


def place(key: Column) -> Column:
    """60 hash bits of an id, from its MD5 digest."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _leaves(cells: DataFrame, depth: int, limit: int) -> DataFrame:
    """(cell, leaf): for each cell the least depth whose bucket needs no split, else null."""
    levels = cells.select(
        "cell", "bytes", "rows", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    ).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - level)"))
    fits = (
        levels.groupBy("level", "bucket")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        .filter((F.col("bytes") <= limit) | (F.col("rows") == 1))
        .select("level", "bucket", F.lit(True).alias("fit"))
    )
    return (
        levels.join(fits, ["level", "bucket"], "left")
        .groupBy("cell")
        .agg(F.min(F.when(F.col("fit"), F.col("level"))).alias("leaf"))
    )


def assign_shards(
    docs: DataFrame, limit_bytes: int = LIMIT_BYTES, carry: bool = False
) -> DataFrame:
    """(doc_id, bytes, shard, depth, page): ``shard`` is the bucket's prefix in binary.

    With ``carry`` the whole row comes along as the struct ``doc``.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []
    sized = docs.select(
        *row,
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        place(F.col("doc_id")).alias("place"),
    )
    todo = written(sized, "shard-sizes")
    total = todo.agg(F.sum("bytes")).first()[0] or 0
    even = max(0, math.ceil(math.log2(max(1, total / limit_bytes))))
    depth, done = min(BITS, even + SPARE_LEVELS), None
    while True:
        cell = F.expr(f"shiftright(place, {BITS - depth})").alias("cell")
        cells = todo.groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        leaves = written(_leaves(written(cells, "shard-cells"), depth, limit_bytes), "shard-leaves")
        placed = todo.withColumn("cell", cell).join(small(leaves), "cell").drop("cell")
        part = placed.filter("leaf is not null").withColumn("page", F.lit(0).cast("bigint"))
        done = part if done is None else done.unionByName(part)
        if not leaves.filter("leaf is null").take(1):
            break
        todo = written(placed.filter("leaf is null").drop("leaf"), "shard-rest")
        if depth == BITS:
            done = done.unionByName(_pages(todo, limit_bytes))
            break
        depth = min(BITS, depth + 2 * SPARE_LEVELS)
    bits = F.expr(f"lpad(bin(shiftright(place, {BITS} - leaf)), leaf, '0')")
    return done.select(
        "doc_id",
        "bytes",
        F.when(F.col("leaf") == 0, "").otherwise(bits).alias("shard"),
        F.col("leaf").cast("bigint").alias("depth"),
        "page",
        *(["doc"] if carry else []),
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, cut into pages by rank; a page holds as many of the largest as fit."""
    largest = written(rows.groupBy("place").agg(F.max("bytes").alias("largest")), "shard-largest")
    ranked = rank_in_groups(rows, ["place"], [F.col("bytes"), F.col("doc_id")], "rk")
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("largest"), F.lit(1))))
    return ranked.join(small(largest), "place").select(
        "place",
        "doc_id",
        "bytes",
        F.lit(BITS).alias("leaf"),
        F.floor((F.col("rk") - 1) / per_page).cast("bigint").alias("page"),
        *[c for c in rows.columns if c == "doc"],
    )


def shard_report(assigned: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(shard, page, rows, bytes, oversize) of every shard."""
    return assigned.groupBy("shard", "page").agg(
        F.count("*").alias("rows"),
        F.sum("bytes").alias("shard_bytes"),
        (F.sum("bytes") > limit_bytes).alias("oversize"),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Write the documents with one folder of files per shard and page."""
    assigned = assign_shards(docs, limit_bytes, carry=True)
    assigned.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
