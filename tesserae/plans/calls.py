"""Model calls: seeds, limits and token counts of every request, and a log with one row per call."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.digest import sample_seed
from tesserae.runtime import scratch_path, stable


class Request(NamedTuple):
    text: str
    seed: int
    max_tokens: int | None
    greedy: bool


class Reply(NamedTuple):
    text: str | None
    input_tokens: int | None = None
    output_tokens: int | None = None


REPLY = "struct<text: string, seconds: double, input_tokens: bigint, output_tokens: bigint, at_cap: boolean>"
LOG = (
    "case_id string, stage string, call_index bigint, seed bigint, seconds double, input_tokens bigint, "
    "output_tokens bigint, at_cap boolean, request string, response string"
)


def replies_of(model: Any, method: str, requests: list[Request]) -> list[Reply]:
    """Replies of a model to a batch.

    A model whose ``takes_requests`` is true gets the requests, any other one their texts. It
    returns replies or bare texts; the tokens of those are counted by ``count``, if it has one.
    """
    given = requests if getattr(model, "takes_requests", False) else [r.text for r in requests]
    said = list(getattr(model, method)(given))
    if len(said) != len(requests):
        raise ValueError(f"{len(said)} replies to {len(requests)} requests")
    # The class may have come to the worker on two ways, so its fields tell.
    if all(hasattr(s, "output_tokens") for s in said):
        return said
    if not hasattr(model, "count"):
        return [Reply(s) for s in said]
    into, out = model.count([r.text for r in requests]), model.count([s or "" for s in said])
    return [Reply(s, i, o) for s, i, o in zip(said, into, out, strict=True)]


def call_model(
    df: DataFrame,
    load: Callable[[], Any],
    request: str,
    seed: str,
    output: str,
    max_tokens: int | None = None,
    greedy: bool = False,
    method: str = "generate",
) -> DataFrame:
    """Add the struct ``output`` by calling ``load().method`` on Arrow batches; rows whose request
    is null get nulls. The model is loaded once per partition. A batch's time is shared evenly."""

    @F.pandas_udf(REPLY)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = None
        for texts, seeds in batches:
            at = texts.index[texts.notna()]
            rows = pd.DataFrame(
                {
                    "text": pd.Series(None, index=texts.index, dtype=object),
                    "seconds": pd.Series(None, index=texts.index, dtype="Float64"),
                    "input_tokens": pd.Series(None, index=texts.index, dtype="Int64"),
                    "output_tokens": pd.Series(None, index=texts.index, dtype="Int64"),
                    "at_cap": pd.Series(None, index=texts.index, dtype="boolean"),
                }
            )
            if len(at):
                model = model or load()
                requests = [Request(t, int(s), max_tokens, greedy) for t, s in zip(texts[at], seeds[at], strict=True)]
                started = time.monotonic()
                replies = replies_of(model, method, requests)
                seconds = (time.monotonic() - started) / len(at)
                capped = lambda n: None if n is None else max_tokens is not None and n >= max_tokens
                rows.loc[at, "text"] = pd.Series([r.text for r in replies], index=at, dtype=object)
                rows.loc[at, "seconds"] = seconds
                rows.loc[at, "input_tokens"] = pd.array([r.input_tokens for r in replies], dtype="Int64")
                rows.loc[at, "output_tokens"] = pd.array([r.output_tokens for r in replies], dtype="Int64")
                rows.loc[at, "at_cap"] = pd.array([capped(r.output_tokens) for r in replies], dtype="boolean")
            yield rows

    # Never evaluated twice for one row or moved past a filter by the optimiser.
    return df.withColumn(output, ask.asNondeterministic()(F.col(request), F.col(seed)))


def token_counts(load: Callable[[], Any], text: Column) -> Column:
    """How many tokens each text has for the model's tokenizer; null for null."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            given = texts[texts.notna()]
            counts = pd.Series(list(model.count(given.tolist())), index=given.index, dtype="Int64")
            yield counts.reindex(texts.index)

    return count(text)


class CallLog:
    """One row per call, keyed by (case_id, stage, call_index).

    A batch of calls is a folder named after it. Writing a batch again replaces it, so a batch
    that is repeated after a failure leaves no second row.
    """

    def __init__(self, root: str | None = None):
        self.root = root
        self.batches: dict[str, list[DataFrame]] = {}
        self.size = 0

    def next_index(self, stage: str) -> DataFrame | None:
        """(case_id, _next): the index of a case's next call of the stage, where it has had one."""
        calls = self.batches.get(stage)
        if not calls:
            return None
        rows = calls[0]
        for more in calls[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("case_id").agg((F.max("call_index") + 1).alias("_next"))

    def append(self, stage: str, calls: DataFrame, batch: str | None = None) -> None:
        spark = calls.sparkSession
        self.root = self.root or scratch_path(spark, "calls")
        self.size += 1
        path = f"{self.root}/batch={batch or f'{self.size:05d}-{stage}'}"
        calls.select(*[name.split(" ")[0] for name in LOG.split(", ")]).write.mode("overwrite").parquet(path)
        kept = spark.read.schema(LOG).parquet(path).select("case_id", "call_index")
        self.batches.setdefault(stage, []).append(kept)

    def read(self, spark) -> DataFrame:
        """All calls with the batch they came in."""
        if self.root is None:
            return spark.createDataFrame([], f"{LOG}, batch string")
        return spark.read.schema(f"{LOG}, batch string").parquet(self.root)


def logged_calls(
    df: DataFrame,
    log: CallLog,
    load: Callable[[], Any],
    stage: str,
    case: Column,
    request: Column,
    seed: int,
    order: list[Column] | None = None,
    seed_text: Column | None = None,
    max_tokens: int | None = None,
    greedy: bool = False,
    method: str = "generate",
    output: str = "_raw",
    batch: str | None = None,
) -> DataFrame:
    """Add ``output``, the model's text, and log the calls.

    Rows with a null request are no calls. A call's index is its place among the case's calls of
    this stage: after those in the log, by ``order`` among those of this batch (one per case
    without an order). Its seed comes from case, stage and index, or from ``seed_text``.
    Replies are stored before anything reads them.
    """
    keyed = df.withColumns({"_request": request, "_case": case.cast("string")})
    place = F.lit(0)
    if order:
        # Only calls are numbered; a case asks for few of one stage at a time.
        called = Window.partitionBy("_case", F.col("_request").isNull()).orderBy(*order)
        place = F.row_number().over(called) - 1
    keyed = keyed.withColumn("_place", place.cast("bigint"))
    before = log.next_index(stage)
    if before is None:
        keyed = keyed.withColumn("_index", F.col("_place"))
    else:
        keyed = keyed.join(before.withColumnRenamed("case_id", "_case"), "_case", "left")
        keyed = keyed.withColumn("_index", F.col("_place") + F.coalesce("_next", F.lit(0))).drop("_next")
    text = F.concat(F.lit(f"{stage}:"), F.col("_index").cast("string")) if seed_text is None else seed_text
    keyed = keyed.withColumn("_seed", sample_seed(seed, F.col("_case"), text))
    replied = stable(call_model(keyed, load, "_request", "_seed", "_reply", max_tokens, greedy, method))
    calls = replied.filter("_request IS NOT NULL").select(
        F.col("_case").alias("case_id"),
        F.lit(stage).alias("stage"),
        F.col("_index").alias("call_index"),
        F.col("_seed").alias("seed"),
        "_reply.*",
        F.col("_request").alias("request"),
    )
    log.append(stage, calls.withColumnRenamed("text", "response"), batch)
    kept = [c for c in df.columns if c != output]
    return replied.select(*kept, F.col("_reply.text").alias(output))
