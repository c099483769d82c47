"""Language identification by interpolated Kneser-Ney character models.

Training text is reduced to runs of letters, each read as `` word `` with its two borders, and
every language gets a character model of order ``ORDER``. The models of all languages lie in
one sorted hash array per order: key, discounted probability per language, and the weight that
the n-gram gives to the next shorter one when it is a context. A document is scored by its
cross-entropy per character under each language; the lowest wins.

Calibration: documents of the training sample that were kept out of the counts give, per
language, the cross-entropy that almost none of its documents exceeds. A document beyond that
bound by ``SLACK`` under its best language is marked ``rejected``; so is one without letters.
Documents of fewer than ``SHORT`` letters and borders are too short to be rejected otherwise.

The models are fitted on a sample of labelled rows of bounded expected size: ``SAMPLE_ROWS``
per language, chosen by hash. Counts of a language are kept in full.

Null text or text without a letter (of a Unicode letter category): ``und``, score 0, rejected. Without any training row all
documents are ``und``. Ties of cross-entropy go to the language first in code point order.
Repeated rows score alike. Columns of the input other than the text are never read for a
prediction and are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import unit_hash

ORDER = 5
SAMPLE_ROWS = 1500
CALIBRATION_SHARE = 0.2
QUANTILE = 0.999
SLACK = 1.5
SHORT = 100
SHARPNESS = 8.0
UNKNOWN = "und"
#: Words of a language that are counted at once, words that are scored at once, and new ones of
#: these that meet the models at once: each of their symbols takes some hundred bytes meanwhile.
COUNTED_AT_ONCE = 20_000
WORDS_AT_ONCE = 100_000
NEW_AT_ONCE = 4_000
CACHED_WORDS = 150_000

#: Letters only; a longer run is read in pieces, so that no piece is unbounded.
LETTERS = re.compile(r"[^\W\d_]{1,40}")
BORDER = 32


def letter_runs(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if text is None or text.isascii():
        return found
    # The pattern also takes numbers such as ½ for letters.
    kept = (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found)
    return [w for w in kept if w]


def symbols_of(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of `` w1 w2 … ``, positions to predict from each word's first border)."""
    joined = " " + " ".join(found) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    border = codes == BORDER
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(border, at, 0))
    reach = at - np.concatenate([[0], last[:-1]])  # symbols back to the latest border before
    return codes, reach


def gram_keys(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """keys[n][i]: hash of the n symbols that end at position i (n from 0)."""
    with np.errstate(over="ignore"):
        keys = [np.zeros(len(codes), dtype=np.uint64)]
        for _ in range(order):
            shorter = np.concatenate([[np.uint64(0)], keys[-1][:-1]])
            mixed = (shorter + codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(mixed ^ (mixed >> np.uint64(29)))
    return keys


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (lang, n, key, context, left, starts, count) from rows (lang, text).

    ``context`` is the key without its last symbol, ``left`` the key without its first, and
    ``starts`` tells that the n-gram begins at a border.
    """
    held: dict[str, list[str]] = {}

    def flush(lang: str) -> Iterator[pd.DataFrame]:
        found = held.pop(lang)
        if not found:
            return
        codes, reach = symbols_of(found)
        keys = gram_keys(codes)
        for n in range(1, ORDER + 1):
            at = np.flatnonzero((reach >= max(1, n - 1)) & (np.arange(len(codes)) > 0))
            key, first, count = np.unique(keys[n][at], return_index=True, return_counts=True)
            at = at[first]
            yield pd.DataFrame(
                {
                    "lang": lang,
                    "n": n,
                    "key": key.view(np.int64),
                    "context": keys[n - 1][at - 1].view(np.int64) if n > 1 else 0,
                    "tail": keys[n - 1][at].view(np.int64),
                    "starts": reach[at] == n - 1,
                    "count": count,
                }
            )

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            mine = held.setdefault(lang, [])
            mine.extend(letter_runs(text))
            if len(mine) > COUNTED_AT_ONCE:
                yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


_COUNTS = "lang string, n int, key bigint, context bigint, tail bigint, starts boolean, count bigint"


class Models:
    """Sorted hash arrays of all languages: per order ``keys`` and, per language, the
    discounted probability ``alpha`` of the n-gram and its weight ``gamma`` as a context."""

    def __init__(self, languages: list[str], uniform: float) -> None:
        self.languages = languages
        self.uniform = uniform
        self.keys: list[np.ndarray] = []
        self.alpha: list[np.ndarray] = []
        self.gamma: list[np.ndarray] = []
        self.bounds = np.full(len(languages), np.inf)

    def word_costs(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(-log p summed over the symbols of each word, per language; symbols per word)."""
        codes, reach = symbols_of(found)
        keys = gram_keys(codes)
        p = np.full((len(codes), len(self.languages)), self.uniform)
        before = None
        for n in range(1, ORDER + 1):
            known = self.keys[n - 1]
            at = np.minimum(np.searchsorted(known, keys[n]), len(known) - 1)
            hit = (known[at] == keys[n]) & (reach >= max(1, n - 1))
            alpha = np.where(hit[:, None], self.alpha[n - 1][at], 0.0)
            if n == 1:
                p = alpha + self.root_gamma * p
            else:
                weight = np.ones_like(p)
                weight[1:] = before[:-1]
                p = np.where((reach >= n - 1)[:, None], alpha + weight * p, p)
            # The left border alone is a context too, though it is never predicted there.
            seen = known[at] == keys[n]
            before = np.where(seen[:, None], self.gamma[n - 1][at], 1.0)
        cost = -np.log(p)
        cost[0] = 0.0
        ends = np.flatnonzero(codes == BORDER)
        total = np.cumsum(cost, axis=0)[ends]
        return np.diff(total, axis=0), np.diff(ends)


def fit(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney estimates from n-gram counts (one row per language and key)."""
    languages = sorted(counts["lang"].unique())
    number = {lang: i for i, lang in enumerate(languages)}
    lang_of = counts["lang"].map(number).to_numpy()
    symbols = counts.loc[counts["n"] == 1, "key"].nunique() + 1
    models = Models(languages, 1.0 / symbols)
    models.root_gamma = np.ones(len(languages))
    tables = []
    for n in range(1, ORDER + 1):
        mine = counts["n"].to_numpy() == n
        rows = counts[mine].assign(l=lang_of[mine])
        if n < ORDER:
            # Below the highest order an n-gram counts once for each symbol seen before it;
            # one that begins at a border has none, and keeps its count.
            longer = counts["n"].to_numpy() == n + 1
            left = counts[longer].assign(l=lang_of[longer]).groupby(["l", "tail"]).size().rename("left")
            rows = rows.join(left, on=["l", "key"])
            kept = rows["starts"] | rows["left"].isna() if n > 1 else rows["left"].isna()
            rows["c"] = np.where(kept, rows["count"], rows["left"].fillna(0))
        else:
            rows["c"] = rows["count"]
        tables.append(rows)
    for n, rows in enumerate(tables, 1):
        keys = np.unique(rows["key"].to_numpy().view(np.uint64))
        if n < ORDER:
            contexts = tables[n]["context"].to_numpy().view(np.uint64)
            keys = np.union1d(keys, contexts)
        models.keys.append(keys)
        models.alpha.append(np.zeros((len(keys), len(languages))))
        models.gamma.append(np.ones((len(keys), len(languages))))
    for n, rows in enumerate(tables, 1):
        for l in range(len(languages)):
            mine = rows[rows["l"] == l]
            c = mine["c"].to_numpy(dtype=float)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = mine["context"].to_numpy()
            _, group = np.unique(context, return_inverse=True)
            total = np.bincount(group, weights=c)
            kinds = np.bincount(group)
            at = np.searchsorted(models.keys[n - 1], mine["key"].to_numpy().view(np.uint64))
            models.alpha[n - 1][at, l] = (c - discount) / total[group]
            weight = discount * kinds / total
            if n == 1:
                models.root_gamma[l] = weight[0] if len(weight) else 1.0
            else:
                at = np.searchsorted(models.keys[n - 2], context.view(np.uint64))
                models.gamma[n - 2][at, l] = weight[group]
    return models


class Scorer:
    """Scores texts, keeping the costs of words it has seen in a bounded table."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.costs = np.zeros((0, len(self.models.languages)))
        self.sizes = np.zeros(0, dtype=np.int64)

    def of_words(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(cost per language, symbols) of each group of words."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        new = list({w for group in groups for w in group if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            parts = [self.models.word_costs(new[i : i + NEW_AT_ONCE]) for i in range(0, len(new), NEW_AT_ONCE)]
            self.costs = np.concatenate([self.costs, *(costs for costs, _ in parts)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in parts)])
        cost = np.zeros((len(groups), len(self.models.languages)))
        size = np.zeros(len(groups), dtype=np.int64)
        for i, group in enumerate(groups):
            at = np.fromiter(map(self.known.__getitem__, group), dtype=np.int64, count=len(group))
            cost[i] = self.costs[at].sum(axis=0)
            size[i] = self.sizes[at].sum()
        return cost, size

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol and language, symbols) of each text."""
        cost = np.zeros((len(texts), len(self.models.languages)))
        size = np.zeros(len(texts), dtype=np.int64)
        groups: list[list[str]] = []
        owner: list[int] = []
        held = 0

        def score() -> None:
            nonlocal held
            if groups:
                c, s = self.of_words(groups)
                np.add.at(cost, owner, c)
                np.add.at(size, owner, s)
            groups.clear()
            owner.clear()
            held = 0

        for i, text in enumerate(texts):
            found = letter_runs(text)
            for start in range(0, len(found), WORDS_AT_ONCE):
                groups.append(found[start : start + WORDS_AT_ONCE])
                owner.append(i)
                held += len(groups[-1])
                if held >= WORDS_AT_ONCE:
                    score()
        score()
        return cost / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, size = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        share = np.exp(-SHARPNESS * (entropy - lowest[:, None]))
        score = 1.0 / share.sum(axis=1)
        empty = size == 0
        far = (size >= SHORT) & (lowest > self.models.bounds[best] * SLACK)
        names = np.array([*self.models.languages, UNKNOWN], dtype=object)
        return pd.DataFrame(
            {
                "lang_pred": names[np.where(empty, len(names) - 1, best)],
                "score": np.where(empty, 0.0, score),
                "cross_entropy": np.where(empty, np.nan, lowest),
                "rejected": empty | far,
            }
        )


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Models | None:
    """Models from rows (key, lang, text) with no nulls in lang and text; None without rows."""
    rows = dict(labelled.groupBy("lang").count().collect())
    if not rows:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, sample_rows / n))])
    sample = labelled.filter(unit_hash("langid", F.col("key")) < share[F.col("lang")])
    kept_out = unit_hash("calibrate", F.col("key")) < CALIBRATION_SHARE
    counted = sample.filter(~kept_out).select("lang", "text").mapInPandas(count_grams, _COUNTS)
    keys = ["lang", "n", "key", "context", "tail", "starts"]
    counts = counted.groupBy(*keys).agg(F.sum("count").alias("count")).toArrow().to_pandas()
    if not len(counts):
        return None
    models = fit(counts)
    scorer = Scorer(models)

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entropy, size = scorer.entropies(list(batch["text"]))
            at = [models.languages.index(x) if x in models.languages else 0 for x in batch["lang"]]
            mine = entropy[np.arange(len(batch)), at]
            known = (size >= SHORT) & batch["lang"].isin(models.languages).to_numpy()
            yield pd.DataFrame({"lang": batch["lang"][known], "entropy": mine[known]})

    held = sample.filter(kept_out).select("lang", "text").mapInPandas(calibrate, "lang string, entropy double")
    for lang, bound in held.groupBy("lang").agg(F.expr(f"percentile(entropy, {QUANTILE})")).collect():
        models.bounds[models.languages.index(lang)] = bound
    return models


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__lang`` (lang_pred, score, cross_entropy, rejected)."""
    kind = "lang_pred string, score double, cross_entropy double, rejected boolean"
    if models is None:
        nothing = F.struct(
            F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"),
            F.lit(True).alias("rejected"),
        )
        return docs.withColumn("__lang", nothing)

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(models)
        for texts in batches:
            yield scorer.predict(list(texts))

    return docs.withColumn("__lang", predict(F.col(text)))
