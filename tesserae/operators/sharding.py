"""Image costs and balanced shards with indivisible images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import grid_tiles
from tesserae.operators.ranking import rank_in_groups
from tesserae.runtime import stable
from tesserae.runtime import require_empty

# Seconds per (tile, question) of the two planning priors.
COST_PRIORS = {"first": (20, 120), "later": (30, 180)}
QUESTION_WEIGHT = 5


def question_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("image_id").agg(F.count("*").alias("questions"))


def costs_by_questions(samples: DataFrame) -> DataFrame:
    return question_counts(samples).select(
        "image_id", (F.col("questions") + 1).cast("double").alias("cost")
    )


def region_counts(images: DataFrame) -> DataFrame:
    tiles = F.when(F.col("input_kind") == "roi", F.lit(1)).otherwise(
        grid_tiles(F.col("width"), F.col("height"))
    )
    return images.select("image_id", tiles.cast("bigint").alias("regions"))


def costs_by_grid(
    samples: DataFrame, images: DataFrame, region_seconds: float, question_seconds: float
) -> DataFrame:
    cost = F.col("regions") * region_seconds + F.col("questions") * question_seconds
    return (
        question_counts(samples)
        .join(region_counts(images), "image_id")
        .select("image_id", cost.cast("double").alias("cost"))
    )


def costs_by_profile(
    samples: DataFrame, images: DataFrame, measured: DataFrame, run_seconds: DataFrame
) -> DataFrame:
    """Scale every image's units by the seconds per unit of a measured run.

    ``measured`` has (image_id, regions, questions); ``run_seconds`` is one row
    (seconds, model_load_seconds).
    """
    units = F.sum(F.col("regions") + QUESTION_WEIGHT * F.col("questions"))
    per_unit = (
        measured.agg(units.alias("units"))
        .crossJoin(run_seconds)
        .select(
            (F.greatest(F.lit(1.0), F.col("seconds") - F.col("model_load_seconds"))
             / F.col("units")).alias("per_unit")
        )
    )
    cost = F.col("per_unit") * (F.col("regions") + QUESTION_WEIGHT * F.col("questions"))
    return (
        question_counts(samples)
        .join(region_counts(images), "image_id")
        .crossJoin(F.broadcast(per_unit))
        .select("image_id", cost.alias("cost"))
    )


def costs_by_history(history: DataFrame) -> DataFrame:
    """Sum of the recorded seconds of every image."""
    return history.groupBy("image_id").agg(F.sum("seconds").alias("cost"))


def check_costs(samples: DataFrame, costs: DataFrame, shards: int) -> None:
    images = samples.select("image_id").distinct()
    require_empty(images.join(costs, "image_id", "left_anti"), "image without a cost")
    require_empty(costs.filter(~(F.col("cost") > 0)), "image cost must be positive")
    if len(images.take(shards)) < shards:
        raise ValueError(f"fewer than {shards} images for {shards} shards")


_RUNS = "cost double, shard int, start double, taken bigint"


def _loads(start: float, cost: float, n: int) -> np.ndarray:
    """Load before each of ``n`` additions and after the last, added up one by one."""
    return np.cumsum(np.concatenate([[start], np.full(n, cost)]))


def _fill(totals: np.ndarray, cost: float, images: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many of ``images`` equal costs each shard takes, its load then), always the least
    loaded next and of equal loads the first shard.

    A shard's places lie at its running loads. A water level tells about how many are needed;
    of these the ``images`` lowest are taken, and more are looked at if one shard ran out.
    """
    taken = np.zeros(len(totals), dtype=np.int64)
    if images == 1 or cost <= 0:
        least = int(np.argmin(totals))
        taken[least] = images
        return taken, np.where(taken > 0, totals + cost * images, totals)
    ordered = np.sort(totals)
    levels = (cost * images + np.cumsum(ordered)) / np.arange(1, len(totals) + 1)
    level = levels[np.flatnonzero(levels > ordered)[-1]]
    spare = 2
    while True:
        offered = np.maximum(0, np.ceil((level - totals) / cost)).astype(np.int64) + spare
        loads = [_loads(t, cost, n) for t, n in zip(totals, offered)]
        shard = np.repeat(np.arange(len(totals)), offered)
        places = np.concatenate([x[:-1] for x in loads])
        lowest = np.lexsort((shard, places))[:images]
        taken = np.bincount(shard[lowest], minlength=len(totals))
        if (taken < offered).all():
            return taken, np.array([x[n] for x, n in zip(loads, taken)])
        spare *= 2


def shard_runs(costs: DataFrame, shards: int) -> DataFrame:
    """For every distinct cost, what each shard takes of it and its load before.

    Costs are visited from the highest down, which is a running state over *distinct*
    costs: only the (cost, image count) histogram passes here, in sorted order and with
    one number per shard as state. Images themselves stay distributed.
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(shards)
        for batch in batches:
            runs = []
            for cost, images in zip(batch["cost"], batch["images"]):
                taken, after = _fill(totals, cost, int(images))
                runs += [(cost, i, totals[i], taken[i]) for i in np.flatnonzero(taken)]
                totals = after
            yield pd.DataFrame(runs, columns=["cost", "shard", "start", "taken"])

    histogram = costs.groupBy("cost").agg(F.count("*").alias("images"))
    ordered = histogram.repartition(1).sortWithinPartitions(F.col("cost").desc())
    return ordered.mapInPandas(visit, _RUNS)


def assign_shards(costs: DataFrame, shards: int = 16) -> DataFrame:
    """(image_id, cost, shard): dearest image first, to the least loaded shard.

    Ties go to the smaller image name and the smaller shard number. Among images of one
    cost the places a shard takes are at its running loads; sorting all places
    of that cost by (load, shard) gives the order in which images, sorted by name, go in.
    """

    def places_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cost, shard, start, taken in batch.itertuples(index=False):
                loads = _loads(start, cost, taken)[:-1]
                yield pd.DataFrame({"cost": cost, "shard": shard, "_load": loads})

    runs = stable(shard_runs(costs, shards)).repartition("cost", "shard")
    places = runs.mapInPandas(places_of, "cost double, shard int, _load double")
    places = rank_in_groups(
        places.select("cost", "shard", "_load"), ["cost"], [F.col("_load"), F.col("shard")], "_turn"
    )
    images = rank_in_groups(costs.select("image_id", "cost"), ["cost"], [F.col("image_id")], "_turn")
    return images.join(places, ["cost", "_turn"]).select("image_id", "cost", "shard")


def make_shards(samples: DataFrame, costs: DataFrame, shards: int = 16) -> DataFrame:
    """Samples with the shard of their image."""
    return samples.join(assign_shards(costs, shards).drop("cost"), "image_id")


def shard_totals(assigned: DataFrame, samples: DataFrame) -> DataFrame:
    per_image = question_counts(samples)
    return (
        assigned.join(per_image, "image_id")
        .groupBy("shard")
        .agg(
            F.count("*").alias("images"),
            F.sum("questions").alias("questions"),
            F.sum("cost").alias("cost"),
        )
    )
