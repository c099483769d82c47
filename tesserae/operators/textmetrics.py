"""Corpus text metrics of open answers: BLEU, ROUGE-L and CIDEr.

All take one reference and one hypothesis text per row id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_N = 4
# Constants of the published metric definitions.
ROUGE_BETA = 1.2
CIDER_SCALE = 10.0
CIDER_SIGMA = 6.0
BLEU_TINY, BLEU_SMALL = 1e-15, 1e-9

#: Bits of the table that tells which hashes shared grams have; 64 to a row.
MARK_BITS = 1 << 26

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)
    )


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(
        F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))


def _sides(pairs: DataFrame, row_id: str, ref: str, hyp: str) -> DataFrame:
    """Tokens of both texts, partitioned by row.

    The texts are shuffled once by their row; every later count per row and gram then
    happens where the row is, and the many times larger gram rows stay in place. The
    partition count is given, because texts are far smaller than what they expand to.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.repartition(parts, row_id)
    return rows.select(
        F.col(row_id).alias("row_id"), tokens(F.col(ref)).alias("_ref"), tokens(F.col(hyp)).alias("_hyp")
    )


def gram_counts(pairs: DataFrame, row_id: str, ref: str, hyp: str) -> DataFrame:
    """(row_id, n, gram, in_ref, in_hyp): one aggregation covers both texts and every n."""
    words = _sides(pairs, row_id, ref, hyp)
    def marked(side: str, n: int, is_ref: int) -> Column:
        return F.transform(
            ngrams(F.col(side), n),
            lambda gram: F.struct(
                F.lit(n).alias("n"), gram.alias("gram"), F.lit(is_ref).alias("is_ref")
            ),
        )

    sizes = range(1, MAX_N + 1)
    listed = [marked("_ref", n, 1) for n in sizes] + [marked("_hyp", n, 0) for n in sizes]
    spread = words.select("row_id", F.explode(F.concat(*listed)).alias("_g")).select(
        "row_id", "_g.n", "_g.gram", "_g.is_ref"
    )
    return spread.groupBy("row_id", "n", "gram").agg(
        F.sum("is_ref").alias("in_ref"), F.sum(1 - F.col("is_ref")).alias("in_hyp")
    )


def bleu(pairs: DataFrame, row_id: str = "row_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row: corpus BLEU-1 to BLEU-4 with brevity penalty."""
    grams = gram_counts(pairs, row_id, ref, hyp)
    matched = grams.groupBy("n").agg(F.sum(F.least("in_ref", "in_hyp")).alias("matched"))
    words = _sides(pairs, row_id, ref, hyp)
    guessed = [
        F.sum(F.greatest(F.size("_hyp") - (n - 1), F.lit(0))).alias(f"_g{n}")
        for n in range(1, MAX_N + 1)
    ]
    lengths = words.agg(
        F.sum(F.size("_ref")).alias("_r"), F.sum(F.size("_hyp")).alias("_h"), *guessed
    )
    by_n = matched.agg(
        *[F.sum(F.when(F.col("n") == n, F.col("matched"))).alias(f"_m{n}") for n in range(1, MAX_N + 1)]
    )
    facts = lengths.crossJoin(by_n)
    ratio = (F.col("_h") + BLEU_TINY) / (F.col("_r") + BLEU_SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    product, scores = F.lit(1.0), []
    for n in range(1, MAX_N + 1):
        hit = F.coalesce(F.col(f"_m{n}"), F.lit(0))
        product = product * (hit + BLEU_TINY) / (F.col(f"_g{n}") + BLEU_SMALL)
        scores.append((F.pow(product, F.lit(1.0 / n)) * penalty).alias(f"bleu_{n}"))
    return facts.select(*scores)


def _lcs_length(left: list, right: list) -> int:
    """Longest common subsequence over bit rows: one big-integer step per word."""
    if len(left) > len(right):
        left, right = right, left
    places: dict = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        hits = row & places.get(word, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(left) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_lcs_length(list(a), list(b)) for a, b in zip(left, right)], dtype="int64")


def rouge_l_rows(pairs: DataFrame, row_id: str = "row_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    words = _sides(pairs, row_id, ref, hyp)
    common = words.select(
        "row_id",
        F.size("_ref").alias("_r"),
        F.size("_hyp").alias("_h"),
        lcs_length("_ref", "_hyp").alias("lcs"),
    )
    precision, recall = F.col("lcs") / F.col("_h"), F.col("lcs") / F.col("_r")
    beta2 = ROUGE_BETA * ROUGE_BETA
    score = F.when(
        F.col("lcs") > 0, (1 + beta2) * precision * recall / (recall + beta2 * precision)
    ).otherwise(F.lit(0.0))
    return common.select("row_id", "lcs", score.alias("rouge_l"))


def rouge_l(pairs: DataFrame, **columns: str) -> DataFrame:
    return rouge_l_rows(pairs, **columns).agg(
        F.count("*").alias("rows"), F.avg("rouge_l").alias("rouge_l")
    )


def _gram_key(gram: Column) -> list[Column]:
    """128 bits that stand for a gram where it is shuffled; its words tell its length."""
    return [F.xxhash64(F.lit(seed), gram).alias(f"_k{seed}") for seed in (1, 2)]


def reference_frequency(words: DataFrame) -> DataFrame:
    """(_k1, _k2, _df): in how many reference texts a gram occurs."""
    listed = [F.array_distinct(ngrams(F.col("_ref"), n)) for n in range(1, MAX_N + 1)]
    spread = words.select(F.explode(F.concat(*listed)).alias("gram")).select(*_gram_key(F.col("gram")))
    return spread.groupBy("_k1", "_k2").agg(F.count("*").alias("_df"))


def _marked(key: Column) -> tuple[Column, Column]:
    """Row and bit of a key in the table of marks."""
    return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(MARK_BITS // 64 - 1)), key.bitwiseAND(F.lit(63)).cast("int")


def cider(pairs: DataFrame, row_id: str = "row_id", ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row: mean CIDEr-D over the rows, document frequencies from the references.

    Grams of at most one reference all weigh the same, so their sums are taken where the row is;
    only sums over the other grams come from a join. Before it, a broadcast table of marks, of a
    bounded size, keeps most grams that are not shared from the shuffle; the join drops those that
    pass by chance. A gram that occurs everywhere is combined before its shuffle.
    """
    grams = gram_counts(pairs, row_id, ref, hyp)
    words = _sides(pairs, row_id, ref, hyp)
    corpus = F.broadcast(words.agg(F.ln(F.count("*").cast("double")).alias("_top")))
    shared = reference_frequency(words).filter("_df > 1").crossJoin(corpus)
    shared = shared.select("_k1", "_k2", (F.col("_top") - F.ln(F.col("_df").cast("double"))).alias("_idf"))
    r, h = F.col("in_ref"), F.col("in_hyp")
    terms = {"dot": F.least(r, h) * r, "nr": r * r, "nh": h * h}
    # Counts of all grams less those of shared ones are whole numbers, so nothing is left of none.
    every = grams.groupBy("row_id", "n").agg(
        *[F.sum(t).alias(f"_{k}_n") for k, t in terms.items()], *[F.lit(0.0).alias(f"_{k}_w") for k in terms]
    )
    idf2 = F.col("_idf") * F.col("_idf")
    place, bit = _marked(F.col("_k1"))
    one = F.lit(1).cast("bigint")
    marks = shared.select(place.alias("_at"), F.call_function("shiftleft", one, bit).alias("_mark")).groupBy("_at")
    marks = F.broadcast(marks.agg(F.bit_or("_mark").alias("_marks")))
    keyed = grams.select("row_id", "n", *_gram_key(F.col("gram")), "in_ref", "in_hyp").withColumn("_at", place)
    likely = keyed.join(marks, "_at").filter(F.call_function("shiftrightunsigned", F.col("_marks"), bit).bitwiseAND(one) == one)
    joined = likely.drop("_at", "_marks").join(shared, ["_k1", "_k2"])
    corrected = joined.groupBy("row_id", "n").agg(
        *[F.sum(-t).alias(f"_{k}_n") for k, t in terms.items()], *[F.sum(t * idf2).alias(f"_{k}_w") for k, t in terms.items()]
    )
    summed = every.unionByName(corrected).groupBy("row_id", "n").agg(
        *[F.sum(f"_{k}_{x}").alias(f"_{k}_{x}") for k in terms for x in "nw"]
    )
    total = {k: F.col(f"_{k}_n") * F.col("_top") * F.col("_top") + F.col(f"_{k}_w") for k in terms}
    per_n = summed.crossJoin(corpus).select(
        "row_id", "n", total["dot"].alias("_dot"), F.sqrt(total["nr"]).alias("_nr"), F.sqrt(total["nh"]).alias("_nh")
    )
    # Lengths count bigrams, as the published implementation does.
    size = {side: F.greatest(F.size(side) - 1, F.lit(0)).cast("double") for side in ("_ref", "_hyp")}
    delta = words.select("row_id", (size["_hyp"] - size["_ref"]).alias("_delta"))
    cosine = F.when(
        (F.col("_nr") != 0) & (F.col("_nh") != 0), F.col("_dot") / (F.col("_nr") * F.col("_nh"))
    ).otherwise(F.col("_dot"))
    damped = cosine * F.exp(-(F.col("_delta") * F.col("_delta")) / (2 * CIDER_SIGMA * CIDER_SIGMA))
    return (
        delta.join(per_n, "row_id", "left")
        .agg(F.sum(F.coalesce(damped, F.lit(0.0))).alias("_sum"), F.count_distinct("row_id").alias("rows"))
        .select("rows", (F.col("_sum") / MAX_N / F.col("rows") * CIDER_SCALE).alias("cider"))
    )
