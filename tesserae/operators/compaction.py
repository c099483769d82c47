"""Shrinking long evidence by summarising blocks, level by level."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranking import block_of, join_blocks, rank_in_groups
from tesserae.runtime import stable

SEPARATOR = "\n\n"
LEVELS = 5


def compact(
    evidence: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    budget: int,
    summarize: Callable[[DataFrame], DataFrame],
    threshold: int = 50,
    chunk: int = 10,
    length: Callable[[Column], Column] = F.length,
    fits: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One text per group within ``budget``: (keys, status, level, chunks, size, text).

    A group fits when its joined text is short enough and, before any summary, has no more
    than ``threshold`` rows. Otherwise blocks of ``chunk`` rows are summarised, at most
    five times; a summary that does not get shorter makes the group ``invalid``, and no row
    is ever left out. Sizes come from sums, so a text is only put together once it is known
    to fit. ``summarize`` maps (keys, block, n_rows, text) to the same with a new text.

    With ``fits`` the size only bounds what is put together: it maps (keys, text) of the groups
    within ``budget`` to (keys, fits), so a whole request can be measured.
    """
    separator = F.length(F.lit(SEPARATOR))
    chunks = rank_in_groups(
        evidence.select(*keys, "text", *_order_columns(evidence, keys)), keys, order, "_rank"
    ).select(*keys, "_rank", "text")
    chunks = chunks.withColumn("_before", F.lit(None).cast("bigint"))
    done: DataFrame | None = None
    for level in range(LEVELS + 1):
        sizes = chunks.groupBy(*keys).agg(
            F.count("*").alias("chunks"),
            (F.sum(length(F.col("text"))) + separator * (F.count("*") - 1)).alias("size"),
            F.max("_before").alias("_before"),
        )
        short = F.col("size") <= budget
        if level == 0:
            short = short & (F.col("chunks") <= threshold)
        grew = F.col("_before").isNotNull() & (F.col("size") >= F.col("_before"))
        out_of_levels = F.lit(level == LEVELS)
        state = (
            F.when(grew, "invalid").when(out_of_levels, "invalid").when(short, "ok").otherwise("next")
        )
        sizes = sizes.select(*keys, "chunks", "size", state.alias("status"))
        marked = chunks.drop("_before").join(sizes, list(keys))
        if fits is not None:
            marked = _measured(stable(marked), keys, fits)
        marked = stable(marked)
        fitting = _joined(marked.filter("status = 'ok'"), [*keys, "status", "chunks", "size"])
        failed = (
            marked.filter("status = 'invalid' AND _rank = 1")
            .select(*keys, "status", "chunks", "size", F.lit(None).cast("string").alias("text"))
        )
        ended = fitting.unionByName(failed).withColumn("level", F.lit(level).cast("bigint"))
        done = ended if done is None else done.unionByName(ended)
        open_groups = marked.filter("status = 'next'")
        if level == LEVELS or not open_groups.take(1):
            break
        blocks = join_blocks(
            open_groups.select(
                *keys,
                "size",
                block_of(F.col("_rank"), chunk).alias("block"),
                ((F.col("_rank") - 1) % chunk).alias("position"),
                "text",
            ),
            [*keys, "size"],
            "text",
            SEPARATOR,
        )
        # Kept at once, so that sizes and texts come from the same calls.
        chunks = stable(
            summarize(blocks).select(
                *keys,
                (F.col("block") + 1).alias("_rank"),
                "text",
                F.col("size").alias("_before"),
            )
        )
    return done.select(*keys, "status", "level", "chunks", "size", "text")


def fit_requests(
    requests: DataFrame,
    evidence: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    request: Callable[[Column], Column],
    count: Callable[[Column], Column],
    room: int,
    summarize: Callable[[DataFrame], DataFrame],
    least_evidence: int = 1024,
    threshold: int = 50,
    longest_token: int = 64,
) -> DataFrame:
    """Evidence shortened until each whole request fits: (keys, status, level, chunks, size, text).

    ``requests`` has one row per group; ``request`` renders its longest request around an evidence
    text, retry and history included, and ``count`` counts its tokens. ``room`` is the context
    without the answer. Where the rest of the request leaves less than ``least_evidence`` tokens, the
    group is ``no_room`` and nothing is summarised. No token stands for more than
    ``longest_token`` characters, so longer evidence is not even put together.
    """
    alone = F.coalesce(count(request(F.lit(""))) <= room - least_evidence, F.lit(False))
    judged = stable(requests.withColumn("_alone", alone))
    able = judged.filter("_alone").drop("_alone", "text")

    def fits(joined: DataFrame) -> DataFrame:
        beside = able.join(joined.select(*keys, "text"), list(keys))
        return beside.select(*keys, (count(request(F.col("text"))) <= room).alias("fits"))

    lines = evidence.join(able.select(*keys), list(keys), "left_semi")
    fitted = compact(lines, keys, order, room * longest_token, summarize, threshold, fits=fits)
    nothing = F.lit(None).cast("bigint")
    without = judged.filter("NOT _alone").select(
        *keys, F.lit("no_room").alias("status"), nothing.alias("level"), nothing.alias("chunks"),
        nothing.alias("size"), F.lit(None).cast("string").alias("text"),
    )
    return fitted.unionByName(without)


def _joined(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    texts = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return chunks.groupBy(*keys).agg(
        F.array_join(F.transform(texts, lambda entry: entry["text"]), SEPARATOR).alias("text")
    )


def _measured(
    marked: DataFrame, keys: Sequence[str], fits: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Groups that seemed short enough, but do not fit once measured, go on."""
    judged = fits(_joined(marked.filter("status = 'ok'"), keys))
    judged = judged.select(*keys, F.coalesce("fits", F.lit(False)).alias("_fits"))
    status = F.when((F.col("status") == "ok") & ~F.col("_fits"), "next").otherwise(F.col("status"))
    return marked.join(judged, list(keys), "left").withColumn("status", status).drop("_fits")


def _order_columns(evidence: DataFrame, keys: Sequence[str]) -> list[str]:
    return [column for column in evidence.columns if column not in {*keys, "text"}]
