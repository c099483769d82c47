"""Importance resampling towards a target distribution, with bit-sliced weights.

Features are runs of one to ``width`` words, hashed into ``buckets``. A bucket's gain is the floored
logarithm of its smoothed share in the target over that in the documents, in thousandths, so it is
a whole number. A document's weight is the floored mean of the gains of its features:

* its bucket counts become bit planes, one bit per bucket: plane ``j`` holds bit ``j`` of all counts;
* the gains become bit planes as well, one set for positive and one for negative gains;
* the sum of gains is the sum over both of ``2**(j + k)`` times the number of bits that plane ``j`` of
  the counts and plane ``k`` of the gains share. It is exact, whatever the order of rows.

Documents with enough words are drawn by the largest sums of weight and Gumbel noise, where the
noise comes from a hash of seed and id. Ranks are exact and made in parallel.

Bucket counts of documents and target cover all texts; each task hands on one sum per bucket, and only
these sums (their number is a parameter) reach the driver and every task.

Null and empty texts have no features: weight 0, not drawn. Equal scores go to the smaller id,
a null id (hashed as ``null``) last; repeated rows are each drawn on their own. No documents give no
rows; without target texts every gain only weighs the documents' own counts. Other columns are not
read. Long texts are read whole, in pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import written
from tesserae.operators.ranking import rank_in_groups

BUCKETS = 10_000
WIDTH = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
PIECE_BYTES = 1 << 22
#: Documents whose planes are made together.
DOCUMENTS_AT_ONCE = 256

#: Digits, a-z and everything beyond ASCII belong to words; A-Z are read as a-z.
WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces of bounded size."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        part = text[start:end].translate(WORD_BYTES)
        if end < len(text):
            cut = part.rfind(b" ") + 1
            while not cut:
                more = text[end : end + PIECE_BYTES].translate(WORD_BYTES)
                at = more.find(b" ") + 1
                part += more[: at or len(more)]
                end += at or len(more)
                cut = len(part) if at or end >= len(text) else 0
            part = part[:cut]
        start += len(part)
        if found := part.split():
            yield found


def feature_buckets(text: bytes, width: int, buckets: int) -> tuple[int, list[np.ndarray]]:
    """How many words a text has, and the buckets of its features."""
    words, carried, found = 0, [], []
    for piece in word_pieces(text):
        words += len(piece)
        run = carried + piece
        for n in range(1, width + 1):
            skip = max(0, len(carried) - n + 1)
            texts = piece if n == 1 else [b" ".join(run[i : i + n]) for i in range(skip, len(run) - n + 1)]
            hashed = np.fromiter(map(zlib.crc32, texts), dtype=np.uint32, count=len(texts))
            found.append((hashed % np.uint32(buckets)).astype(np.int64))
        carried = run[-(width - 1) :] if width > 1 else []
    return words, found


def bucket_sums(texts: DataFrame, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts (text) are in each bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for found in feature_buckets(text.as_py() or b"", width, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(scan, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for bucket, n in sums.collect():
        total[bucket] = n
    return total


def bucket_gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    more, fewer = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    ratios = (target + 1).astype(float) * more / ((raw + 1).astype(float) * fewer)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], dtype=np.int64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of 64-bit words."""
    rows = np.packbits(bits, axis=-1)
    padded = np.zeros((*rows.shape[:-1], -(-rows.shape[-1] // 8) * 8), dtype=np.uint8)
    padded[..., : rows.shape[-1]] = rows
    return padded.view(np.uint64)


def gain_planes(gains: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bit planes of the gains, and the signed power of two of each."""
    planes, values = [np.zeros((0, len(gains)), dtype=np.uint8)], []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for k in range(int(size.max(initial=0)).bit_length()):
            planes.append(((size >> k) & 1).astype(np.uint8)[None])
            values.append(sign << k)
    return packed(np.concatenate(planes)), values


def gain_sums(counts: list[tuple[np.ndarray, np.ndarray]], planes: np.ndarray, values: list[int], buckets: int) -> list[int]:
    """The sum of count times gain of each document, given as (buckets, counts)."""
    sums = [0] * len(counts)
    powers = np.array(values, dtype=np.int64)
    highest = max((int(n.max(initial=0)) for _, n in counts), default=0).bit_length()
    for j in range(highest):
        rows = [i for i, (_, n) in enumerate(counts) if int(n.max(initial=0)) >> j]
        bits = np.zeros((len(rows), buckets), dtype=np.uint8)
        for place, i in enumerate(rows):
            where, n = counts[i]
            bits[place, where] = (n >> j) & 1
        mine = packed(bits)
        part = np.zeros(len(rows), dtype=np.int64)
        for plane, power in zip(planes, powers, strict=True):
            part += power * np.bitwise_count(mine & plane).sum(axis=1, dtype=np.int64)
        for i, value in zip(rows, part.tolist(), strict=True):
            sums[i] += value << j
    return sums


def weigh(docs: DataFrame, gains: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of documents (doc_id, text)."""
    buckets = len(gains)
    planes, values = gain_planes(gains)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for start in range(0, len(ids), DOCUMENTS_AT_ONCE):
                words, counts = [], []
                for text in texts.slice(start, DOCUMENTS_AT_ONCE):
                    total = np.zeros(buckets, dtype=np.int64)
                    size, pieces = feature_buckets(text.as_py() or b"", width, buckets)
                    for found in pieces:
                        total += np.bincount(found, minlength=buckets)
                    where = np.flatnonzero(total)
                    words.append(size)
                    counts.append((where, total[where]))
                features = [int(n.sum()) for _, n in counts]
                sums = gain_sums(counts, planes, values, buckets)
                weights = [s // n if n else 0 for s, n in zip(sums, features, strict=True)]
                columns = [ids.slice(start, DOCUMENTS_AT_ONCE), *(pa.array(c, type=pa.int64()) for c in (words, features, weights))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = BUCKETS,
    width: int = WIDTH,
    seed: str = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of documents (doc_id, text) drawn towards
    the texts (text) of ``target``; rank is null where a document isn't drawn."""
    gains = bucket_gains(bucket_sums(target, width, buckets), bucket_sums(docs, width, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, width).withColumn("score", (F.col("weight") + noise).cast("bigint"))
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "weights")
    eligible = scored.filter(F.col("n_words") >= least_words)
    draws = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    ranked = rank_in_groups(eligible, [], order, "rank")
    rank = F.when(F.col("rank") <= draws, F.col("rank"))
    others = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.withColumn("rank", rank).unionByName(others).drop("_row")
