"""Profiles of model calls and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.digest import sample_seed
from tesserae.operators.ranking import rank_in_groups


def profile_calls(calls: DataFrame, cap: int | Column | None = None) -> DataFrame:
    """Calls, seconds, tokens and token-cap hits per (stage, case), per stage and overall.

    The fine level is aggregated first; the two coarser ones are sums of it.
    """
    at_cap = F.lit(False) if cap is None else F.coalesce(F.col("output_tokens") >= cap, F.lit(False))
    sums = ["seconds", "input_tokens", "output_tokens"]
    fine = calls.groupBy("stage", "case_id").agg(
        F.count("*").alias("calls"),
        *[F.sum(name).alias(name) for name in sums],
        F.count_if(at_cap).alias("cap_hits"),
    )
    totals = [F.sum(name).alias(name) for name in ("calls", *sums, "cap_hits")]
    rolled = fine.rollup("stage", "case_id").agg(
        *totals, F.grouping_id().cast("bigint").alias("level")
    )
    return rolled.withColumn("mean_seconds", F.col("seconds") / F.col("calls"))


def image_profile(calls: DataFrame, samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Seconds, regions and questions per image; calls are keyed by sample."""
    seconds = calls.groupBy("sample_id").agg(F.sum("seconds").alias("_s"))
    per_image = (
        samples.join(seconds, "sample_id", "left")
        .groupBy("image_id")
        .agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("seconds"), F.count("*").alias("questions"))
    )
    tiles = regions.groupBy("image_id").agg(F.count("*").alias("regions"))
    return per_image.join(tiles, "image_id", "left").select(
        "image_id", "seconds", F.coalesce("regions", F.lit(0)).cast("bigint").alias("regions"), "questions"
    )


def call_seeds(calls: DataFrame, order: list[Column], seed: int) -> DataFrame:
    """Calls with their running index per (case, stage) and the seed derived from it."""
    ranked = rank_in_groups(calls, ["case_id", "stage"], order, "_rank")
    index = F.col("_rank") - 1
    stage = F.concat(F.col("stage"), F.lit(":"), index.cast("string"))
    return ranked.select(
        *calls.columns,
        index.alias("call_index"),
        sample_seed(seed, F.col("case_id"), stage).alias("seed"),
    )


def check_cohorts(members: DataFrame, cohorts: DataFrame, size: int | Column) -> DataFrame:
    """Every cohort found or expected, with its distinct slides and whether that is right."""
    found = members.groupBy("cohort").agg(F.count_distinct("slide_id").alias("slides"))
    known = cohorts.select("cohort").distinct().withColumn("_known", F.lit(True))
    slides = F.coalesce(F.col("slides"), F.lit(0)).cast("bigint")
    is_known = F.col("_known").isNotNull()
    return found.join(known, "cohort", "full").select(
        "cohort",
        slides.alias("slides"),
        is_known.alias("known"),
        (is_known & (slides == F.lit(size))).alias("ok"),
    )


def plan_totals(files: DataFrame) -> DataFrame:
    """Files, bytes and GiB per cohort and overall (null cohort)."""
    return (
        files.groupBy("cohort")
        .agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_b"))
        .rollup("cohort")
        .agg(F.sum("_n").alias("files"), F.sum("_b").alias("bytes"))
        .select("cohort", "files", "bytes", F.round(F.col("bytes") / 1024**3, 3).alias("gib"))
    )
