"""Quality selection by importance resampling.

Texts become hashed counts of words, signs and their pairs in ``BUCKETS`` buckets. Two generative models,
of the target (documents labelled good) and of the raw corpus, give every document the log ratio
of its probabilities, over the root of its length, so that long documents are not judged by their
length. Divided by ``TEMPERATURE``, with a Gumbel draw per document added that is seeded by its
id, the k largest sums are a sample without replacement in proportion to the tempered ratios.

The raw model counts every document. The target model is fitted on at most about
``SAMPLE_ROWS`` labelled documents, chosen by hash, and leans on the raw model by ``LEAN`` counts
per bucket, so that what the sample never showed counts neither way. The sample size k is
calibrated: labelled documents of both kinds give the log ratio that parts them best, and k is
the number of documents above it. A document is scored by models that have not seen it. Without
good labels all ratios are one and everything is kept; without bad ones the ratio one parts.

Null and empty texts have log ratio 0. A null id draws like the text ``null``. Rows of equal id
draw alike; at the cut, rows of equal sum are taken in order of id, a null id first, and
repeated rows share one fate. Labels that contradict each other count for the worse. An empty table
gives no rows. Other columns are carried along by ``select_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small, unit_hash, written
from tesserae.operators.ranking import rank_in_groups

BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
LEAN = 20
#: Log ratios are divided by this before the draw is added.
TEMPERATURE = 0.02
#: A share of good documents lost weighs so many times a share of bad ones kept.
KEEP_WEIGHT = 3
TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
TEXT_RUN = 1 << 22
CACHED_TOKENS = 150_000


class Hasher:
    """Buckets of a text's tokens and token pairs."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_TOKENS:
            known.clear()
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh64_intdigest(token.encode())
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def buckets(self, text: str | None) -> Iterator[np.ndarray]:
        before = np.zeros(0, dtype=np.uint64)
        for start in range(0, len(text or ""), TEXT_RUN):
            # A run that cuts a word makes two of it, in every pass alike.
            found = self.hashes(TOKENS.findall(text[start : start + TEXT_RUN].lower()))
            if len(found):
                path = np.concatenate([before, found])
                with np.errstate(over="ignore"):
                    pairs = path[:-1] * np.uint64(0x9E3779B97F4A7C15) + path[1:]
                    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                shift = np.uint64(64 - 16)
                yield (np.concatenate([found, pairs]) >> shift).astype(np.int64)
                before = found[-1:]


@dataclass
class Model:
    """Counts per bucket of both generative models, and the log ratio that parts good from bad."""

    raw: np.ndarray
    target: np.ndarray
    part: float = 0.0

    def log_weight(self, hasher: Hasher, text: str | None, in_target: bool) -> float:
        """Log ratio of a document, over the root of its number of counts.

        One count per bucket is taken out of the raw model, and of the target model if the
        document was part of it, so that being in the corpus does not speak for or against
        it. What it repeats stays in the raw model and speaks against it.
        """
        found = list(hasher.buckets(text))
        if not found or not self.target.any():
            return 0.0
        if sum(map(len, found)) < BUCKETS:
            bucket, count = np.unique(np.concatenate(found), return_counts=True)
        else:
            table = sum(np.bincount(f, minlength=BUCKETS) for f in found)
            bucket = np.flatnonzero(table)
            count = table[bucket]
        own = len(bucket)
        p_raw = (self.raw[bucket] - 1 + 0.5) / (self.raw.sum() - own + 0.5 * BUCKETS)
        lean = float(LEAN * BUCKETS)
        p_target = (self.target[bucket] - in_target + lean * p_raw) / (self.target.sum() - own * in_target + lean)
        return float((count * np.log(p_target / p_raw)).sum() / np.sqrt(count.sum()))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    hasher = Hasher()
    for batch in batches:
        for text, good in zip(batch["text"], batch["good"], strict=True):
            for found in hasher.buckets(text):
                counts = np.bincount(found, minlength=BUCKETS) if len(found) > BUCKETS else None
                for table in (raw, target) if good else (raw,):
                    if counts is None:
                        np.add.at(table, found, 1)
                    else:
                        table += counts
    bucket = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": bucket, "raw": raw[bucket], "target": target[bucket]})


def score_column(model: Model, text: Column, in_target: Column) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts, inside in batches:
            yield pd.Series(
                [model.log_weight(hasher, t, bool(g)) for t, g in zip(texts, inside, strict=True)], dtype=float
            )

    return score(text, in_target)


def gumbel(key: Column, seed: str = "gumbel") -> Column:
    """-log(-log u) of a draw strictly between 0 and 1."""
    u = (unit_hash(seed, key) * float(1 << 52) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def parting(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut that best parts good from bad, shares of each kind weighed, the lowest of equals,
    midway to the next score below."""
    if good.all() or not good.any():
        return 0.0
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    # Cut i drops the i lowest scores.
    kept_good = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    dropped_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    able = np.concatenate([[True], scores[1:] > scores[:-1], [False]])
    best = int(np.argmax(np.where(able, KEEP_WEIGHT * kept_good + dropped_bad, -1)))
    return float(scores[0] - 1 if best == 0 else (scores[best - 1] + scores[best]) / 2)


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """(labelled, good) of at most about ``rows`` documents of each kind."""
    known = labels.filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    sizes = dict(known.groupBy("good").count().collect())
    share = F.when(F.col("good"), min(1.0, rows / max(1, sizes.get(True, 0)))).otherwise(
        min(1.0, rows / max(1, sizes.get(False, 0)))
    )
    chosen = known.filter(unit_hash("sample", F.col("doc_id")) < share)
    return small(written(chosen.select(F.col("doc_id").alias("__labelled"), F.col("good").alias("__good")), "sample"))


def _judged(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``docs`` with ``__good``: true in the target sample, false if known as bad, else null."""
    return docs.join(sample, docs["doc_id"] == sample["__labelled"], "left").drop("__labelled")


def fit(docs: DataFrame, sample: DataFrame) -> Model:
    """Both models from documents (doc_id, text), and where they part the labelled ones."""
    texts = _judged(docs.select("doc_id", "text"), sample)
    inside = F.coalesce("__good", F.lit(False))
    counted = texts.select("text", inside.alias("good")).mapInPandas(_count, "bucket int, raw bigint, target bigint")
    model = Model(np.zeros(BUCKETS), np.zeros(BUCKETS))
    for bucket, raw, target in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        model.raw[bucket], model.target[bucket] = raw, target
    if model.target.any():
        known = texts.filter("__good is not null")
        judged = known.select("__good", score_column(model, F.col("text"), inside)).collect()
        scores = np.array([row[1] for row in judged])
        model.part = parting(scores, np.array([row[0] for row in judged], dtype=bool))
    return model


def cut_of(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """(key, doc_id) of the k-th largest key of a written table; None if k is 0."""
    if k < 1:
        return None
    order = [F.col("key").desc(), F.col("doc_id").asc_nulls_first()]
    row = rank_in_groups(keys.select("key", "doc_id"), [], order, "rk").filter(F.col("rk") == k).first()
    return (row.key, row.doc_id)


def _within(cut: tuple[float, int | None] | None, key: Column, doc: Column) -> Column:
    if cut is None:
        return F.lit(False)
    tied = doc.isNull() if cut[1] is None else doc.isNull() | (doc <= cut[1])
    return (key > cut[0]) | ((key == cut[0]) & tied)


def _scores(docs: DataFrame, labels: DataFrame, seed: str, rows: int):
    """(model, label sample, scores of all documents, cut)."""
    sample = _sample(labels, rows)
    model = fit(docs, sample)
    texts = _judged(docs.select("doc_id", "text"), sample)
    weight = score_column(model, F.col("text"), F.coalesce("__good", F.lit(False)))
    scores = texts.select("doc_id", weight.alias("log_weight"))
    table = written(scores.withColumn("key", F.col("log_weight") / TEMPERATURE + gumbel(F.col("doc_id"), seed)), "importance")
    return model, sample, table, cut_of(table, table.filter(F.col("log_weight") >= model.part).count())


def resample(
    docs: DataFrame, labels: DataFrame, seed: str = "gumbel", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(doc_id, log_weight, key, selected) of every document."""
    _, _, table, cut = _scores(docs, labels, seed, sample_rows)
    return table.withColumn("selected", _within(cut, F.col("key"), F.col("doc_id")))


def select_documents(
    docs: DataFrame, labels: DataFrame, seed: str = "gumbel", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of ``docs`` in the sample, with all their columns."""
    model, sample, _, cut = _scores(docs, labels, seed, sample_rows)
    weight = score_column(model, F.col("text"), F.coalesce("__good", F.lit(False)))
    found = _judged(docs, sample).withColumn("__key", weight / TEMPERATURE + gumbel(F.col("doc_id"), seed))
    return found.filter(_within(cut, F.col("__key"), F.col("doc_id"))).drop("__key", "__good")
