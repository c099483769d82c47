"""Reproducible stratified samples and small selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.digest import digest, seeded_digest
from tesserae.functions.text import json_string
from tesserae.operators.ranking import rank_in_groups, top_k


def strata_quotas(df: DataFrame, strata: Sequence[str], size: int) -> DataFrame:
    """Strata with their row count and their share of a sample of ``size`` rows.

    A stratum starts with max(1, size·count // total). What is then missing goes to the
    strata furthest below their exact share, one row each; what is too much comes off
    those furthest above it. Both steps are ranks over the strata table, which holds at
    most ``size`` rows because every stratum gets at least one.
    """
    counts = df.groupBy(*strata).agg(F.count("*").alias("source_count"))
    whole = Window.partitionBy()
    started = counts.withColumn("_total", F.sum("source_count").over(whole)).withColumn(
        "_quota",
        F.greatest(F.lit(1), F.expr(f"({size} * source_count) div _total")).cast("bigint"),
    )
    started = started.withColumn("_sum", F.sum("_quota").over(whole))
    descending = [F.col(key).desc() for key in strata]
    deficit = F.lit(size) * F.col("source_count") - F.col("_quota") * F.col("_total")
    can_grow = F.col("_quota") < F.col("source_count")
    grown = started.withColumn(
        "_turn",
        F.row_number().over(Window.partitionBy(can_grow).orderBy(deficit.desc(), *descending)),
    ).withColumn(
        "_more",
        (can_grow & (F.col("_turn") <= F.lit(size) - F.col("_sum"))).cast("bigint"),
    )
    cuts = (
        started.filter((F.col("_sum") > size) & (F.col("_quota") > 1))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_quota") - 2)))
        .withColumn("_surplus", -deficit - F.col("_step") * F.col("_total"))
        .withColumn(
            "_turn",
            F.row_number().over(
                Window.partitionBy().orderBy(F.col("_surplus").desc(), *descending)
            ),
        )
        .filter(F.col("_turn") <= F.col("_sum") - F.lit(size))
        .groupBy(*strata)
        .agg(F.count("*").alias("_less"))
    )
    return grown.join(cuts, list(strata), "left").select(
        *strata,
        "source_count",
        (F.col("_quota") + F.col("_more") - F.coalesce("_less", F.lit(0))).alias("sample_count"),
    )


def stratified_sample(
    df: DataFrame, strata: Sequence[str], id_column: str, size: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(sampled rows, strata table). Rows are drawn by the digest of (seed, id)."""
    check_sample_size(df, strata, id_column, size)
    quotas = strata_quotas(df, strata, size)
    # A quota never exceeds the sample size, so at most ``size`` rows per stratum and task
    # reach the shuffle.
    drawn = top_k(
        df.withColumn("_draw", seeded_digest(seed, F.col(id_column).cast("string"))),
        strata,
        [F.col("_draw"), F.col(id_column).cast("string")],
        size,
        "_turn",
    )
    sample = (
        drawn.join(F.broadcast(quotas), list(strata))
        .filter(F.col("_turn") <= F.col("sample_count"))
        .select(*df.columns)
    )
    return sample, quotas


def check_sample_size(df: DataFrame, strata: Sequence[str], id_column: str, size: int) -> None:
    facts = df.agg(
        F.count("*").alias("rows"),
        F.count_distinct(F.struct(*strata)).alias("strata"),
    ).first()
    if not facts["strata"] <= size <= facts["rows"]:
        raise ValueError(f"sample of {size} from {facts['rows']} rows in {facts['strata']} strata")
    if df.groupBy(id_column).count().filter("count > 1").take(1):
        raise ValueError("repeated ids")


def id_digest(column: str) -> Column:
    return digest(json_string(F.col(column)))


def smoke_by_source(samples: DataFrame, per_source: int = 2) -> DataFrame:
    """The first rows per source in digest order."""
    picked = top_k(
        samples.withColumn("_draw", id_digest("sample_id")),
        ["source"],
        [F.col("_draw"), F.col("sample_id")],
        per_source,
        "_turn",
    )
    return picked.select(*samples.columns)


def _order_statistics(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest, middle (index n // 2) and largest image per group by (area, image)."""
    ranked = rank_in_groups(sizes, keys, [F.col("area"), F.col("image_id")], "_rank")
    counts = sizes.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = ranked.join(counts, list(keys)) if keys else ranked.crossJoin(F.broadcast(counts))
    at = F.col("_rank") - 1
    return placed.filter(
        (at == 0) | (at == F.floor(F.col("_n") / 2)) | (at == F.col("_n") - 1)
    ).select(*keys, "image_id")


def smoke_by_area(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Every question of the smallest, middle and largest image that has questions."""
    sizes = images.select("image_id", (F.col("width") * F.col("height")).alias("area")).join(
        samples.select("image_id").distinct(), "image_id", "left_semi"
    )
    picked = _order_statistics(sizes, [])
    return samples.join(picked, "image_id", "left_semi")


def smoke_mixed(samples: DataFrame, groups: int = 2, each: int = 2) -> DataFrame:
    """Closed and open questions of the first images that have enough of both."""
    closed = F.col("closed")
    eligible = (
        samples.groupBy("image_id")
        .agg(F.count_if(closed).alias("_closed"), F.count_if(~closed).alias("_open"))
        .filter((F.col("_closed") >= each) & (F.col("_open") >= each))
        .orderBy("image_id")
        .limit(groups)
        .select("image_id")
    )
    rows = samples.join(F.broadcast(eligible), "image_id", "left_semi")
    picked = top_k(
        rows.withColumn("_draw", id_digest("sample_id")),
        ["image_id", "closed"],
        [F.col("_draw"), F.col("sample_id")],
        each,
        "_turn",
    )
    return picked.select(*samples.columns)


def smoke_covering(samples: DataFrame, images: DataFrame) -> DataFrame:
    """Smallest, middle and largest image per source, plus one row per uncovered task."""
    # An image belongs to the source of its questions.
    owner = samples.groupBy("image_id").agg(F.min("source").alias("source"))
    sizes = images.select("image_id", (F.col("width") * F.col("height")).alias("area")).join(
        owner, "image_id"
    )
    base = samples.join(
        _order_statistics(sizes, ["source"]).select("image_id").distinct(),
        "image_id",
        "left_semi",
    )
    covered = base.select("task").distinct()
    extra = top_k(
        samples.join(covered, "task", "left_anti").withColumn(
            "_draw", id_digest("sample_id")
        ),
        ["task"],
        [F.col("_draw"), F.col("sample_id")],
        1,
        "_turn",
    )
    return base.unionByName(extra.select(*samples.columns))


def pick_smallest(
    files: DataFrame, case: str, eligible: Column, limit: int
) -> tuple[DataFrame, DataFrame]:
    """(selected files, ineligible files met on the way).

    Files are taken smallest first, one per case, until ``limit`` cases are served. An
    ineligible file is reported when it would have been looked at before that point.
    """
    order = [F.col("size"), F.col("name")]
    best = (
        top_k(files.filter(eligible), [case], order, 1, "_turn")
        .orderBy(*order)
        .limit(limit)
        .select(*files.columns)
    )
    last = best.agg(F.max(F.struct("size", "name")).alias("_last"), F.count("*").alias("_n"))
    served = F.broadcast(best.select(case, F.struct("size", "name").alias("_served")))
    skipped = (
        files.filter(~eligible)
        .crossJoin(F.broadcast(last))
        .join(served, case, "left")
        .filter((F.col("_n") < limit) | (F.struct("size", "name") < F.col("_last")))
        .filter(F.col("_served").isNull() | (F.struct("size", "name") < F.col("_served")))
        .select(*files.columns)
    )
    return best, skipped
