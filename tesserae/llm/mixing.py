"""Mixing sources to target weights by repetition rates.

Words per source are aggregated, targets follow from weights under a cap, and every document
is emitted ``floor(rate)`` times plus one more time if a hash-seeded draw falls below the
fraction of the rate.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id
draws like the text ``null``. Repeated rows draw alike, as the draw depends on the id only.
Documents without words are never emitted by a source of size 0. An empty table gives an empty
mix. Columns of the input that are not named are carried through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import small, unit_hash, written

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
) -> DataFrame:
    """(source, source_size, target, rate) of a table (source, size).

    Weights repeat along the sources in code point order. ``budget`` times all words are
    shared by weight; a source stops at ``cap`` times its own words and what it leaves goes
    to the others by weight. That fixed point is a water level: target = min(cap, level times
    weight). With sources in the order of cap/weight, the level is the largest of
    (budget - caps before) / (weights from here on).
    """
    if not 0 <= budget <= cap:
        raise ValueError("the budget must lie between nothing and the cap")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    limit = (F.col("source_size") * float(cap)).alias("most")
    weighed = per_source.select("source", "source_size", weight.alias("weight"), limit)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    candidate = (F.sum("source_size").over(everything) * float(budget) - filled) / F.sum("weight").over(onward)
    levels = weighed.withColumn("candidate", candidate)
    level = F.max("candidate").over(everything)
    target = F.least(F.col("most"), level * F.col("weight"))
    return levels.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def rates(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    budget: float = BUDGET,
    cap: float = CAP,
) -> DataFrame:
    sizes = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return small(written(source_targets(sizes, weights, budget, cap), "mix-rates"))


def copies_of(rate: Column, key: Column, seed: str = "mix") -> Column:
    """floor(rate), plus one if the draw of ``key`` lies below the fraction."""
    whole = F.floor(rate)
    return (whole + (unit_hash(seed, key) < rate - whole).cast("int")).cast("bigint")


def mix_plan(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document."""
    table = rates(docs, **options)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    copies = copies_of(table["rate"], sized["doc_id"], seed)
    return sized.join(table, sized["source"].eqNullSafe(table["source"])).select(
        sized["doc_id"],
        sized["size"],
        table["source_size"],
        table["target"],
        copies.alias("copies"),
        (copies * sized["size"]).alias("taken"),
    )


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is due, with all its columns."""
    table = rates(docs, **options)
    rate = table.select(F.col("source").alias("__of"), F.col("rate").alias("__rate"))
    joined = docs.join(small(rate), docs["source"].eqNullSafe(rate["__of"]))
    copies = copies_of(F.col("__rate"), docs["doc_id"], seed)
    return (
        joined.withColumn("__n", copies)
        .filter("__n > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
        .select(*[docs[c] for c in docs.columns])
    )
