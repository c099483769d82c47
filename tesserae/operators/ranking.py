"""Row numbers and ordered blocks that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import stable


def rank_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rk"
) -> DataFrame:
    """Number the rows of each group from 1; ``order`` must be a total order.

    The rows are range-partitioned on (keys, order), so a group larger than a task is
    spread over neighbouring slices. Slices are numbered on their own and shifted by the
    size of the group's earlier slices. Only the first group of a slice can have started
    before it, hence there are at most as many shifts as slices and they are broadcast.
    The partitioned rows are checkpointed first: range bounds come from a sample, and both
    uses must see the same slices.
    """
    keyed = df.repartitionByRange(*[F.col(key) for key in keys], *order)
    sliced = stable(keyed.withColumn("_slice", F.spark_partition_id()))
    local = sliced.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    )
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .filter("_shift > 0")
        .drop("_size")
    )
    same = F.lit(True)
    for key in keys:
        same = same & local[key].eqNullSafe(shifts[key])
    joined = local.join(
        F.broadcast(shifts), same & (local["_slice"] == shifts["_slice"]), "left"
    )
    rank = (F.col("_local") + F.coalesce(shifts["_shift"], F.lit(0))).cast("bigint")
    return joined.select(*[local[column] for column in df.columns], rank.alias(name))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rk"
) -> DataFrame:
    """First ``k`` rows per group for a small fixed ``k``.

    The literal bound lets Spark drop all but ``k`` rows per group before the shuffle.
    """
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col(name) <= F.lit(k))


def block_of(rank: Column, size: int) -> Column:
    return F.floor((rank - 1) / size).cast("bigint")


def chunk_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int = 10
) -> DataFrame:
    """Add ``block`` (0-based, ``size`` rows each, in order) and ``position`` inside it."""
    ranked = rank_in_groups(df, keys, order, "_rank")
    return ranked.select(
        *df.columns,
        block_of(F.col("_rank"), size).alias("block"),
        ((F.col("_rank") - 1) % size).alias("position"),
    )


def join_blocks(
    blocks: DataFrame, keys: Sequence[str], text: str, separator: str = "\n\n"
) -> DataFrame:
    """Ordered concatenation of every block; a block has a fixed number of rows at most."""
    pieces = F.array_sort(F.collect_list(F.struct("position", text)))
    return blocks.groupBy(*keys, "block").agg(
        F.count("*").alias("n_rows"),
        F.array_join(F.transform(pieces, lambda piece: piece[text]), separator).alias(text),
    )


def split_contiguous(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Assign sorted names to ``parts`` contiguous runs of ceil(N/parts) names."""
    ranked = rank_in_groups(df.select(name).distinct(), [], [F.col(name)], "_rank")
    total = ranked.agg(F.count("*").alias("_total"))
    size = F.ceil(F.col("_total") / parts)
    return ranked.crossJoin(F.broadcast(total)).select(
        name, (F.floor((F.col("_rank") - 1) / size) + 1).cast("bigint").alias("part")
    )
