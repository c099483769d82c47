"""Approximate nearest neighbours with a permutation index.

``PIVOTS`` vectors, a bounded sample of the distinct ones, are the pivots. Every vector is
represented by its pivots in order of nearness and posted, with the pivot's place in that
order, in the inverted file of each of its ``posted`` nearest pivots. A query walks the files of its own
nearest pivots and adds up the footrule, the sum of differences between places; the vectors of
least footrule are candidates and are ranked again by the inner product of the original
vectors, in double precision.

Vectors are dealt into blocks of bounded size by a hash of their id, each with inverted files of
its own; query batches of bounded size visit every block. From a block come the best of its share of candidates:
``CANDIDATE_SHARE`` of the rows, or ``LEAST_CANDIDATES`` of the whole table if that is more.
Vectors of unequal length are lifted to one length by one more coordinate (a query gets zero
there), so that nearness of directions is nearness by inner product.

Rows whose id or vector is null, or whose vector is empty, zero or holds a null or non-finite
component, take no part. Vectors meet only others of their width. Of repeated ids one row asks,
all are candidates, and none answers its own id. Ties go to the smaller id, among candidates
too. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import written
from tesserae.operators.ranking import top_k

PIVOTS = 64
K = 20
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
CANDIDATE_SHARE = 0.2
LEAST_CANDIDATES = 4000
PLACES_AT_ONCE = 1024


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _sample(n: int):
    """The ``n`` distinct vectors of least hash, per width, of a part."""

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch])
            held = held.drop_duplicates(["width", "hash"]).sort_values("hash").groupby("width").head(n)
        if held is not None:
            yield held

    return least


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by width: at most ``n`` distinct vectors of each width."""
    schema = "width int, hash bigint, vector array<double>"
    hashed = vectors.select("width", F.xxhash64("vector").alias("hash"), "vector")
    some = hashed.mapInPandas(_sample(n), schema).dropDuplicates(["width", "hash"])
    chosen: dict[int, list] = {}
    for row in top_k(some, ["width"], [F.col("hash")], n).orderBy("width", "rk").collect():
        chosen.setdefault(row.width, []).append(row.vector)
    return {width: np.array(rows, dtype=np.float64) for width, rows in chosen.items()}


def places_of(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """places[i, p]: place of pivot p in the order of vector i, nearest first."""
    places = np.empty((len(vectors), len(pivots)), dtype=np.int32)
    for start in range(0, len(vectors), PLACES_AT_ONCE):
        part = vectors[start : start + PLACES_AT_ONCE]
        order = np.argsort(-(part @ pivots.T), axis=1, kind="stable")
        np.put_along_axis(places[start : start + len(part)], order, np.arange(len(pivots), dtype=np.int32)[None, :], 1)
    return places


class InvertedFiles:
    """One list of (row, place) per pivot."""

    def __init__(self, places: np.ndarray, posted: int) -> None:
        self.rows, self.posted = len(places), posted
        self.lists = []
        for pivot in range(places.shape[1]):
            rows = np.flatnonzero(places[:, pivot] < posted)
            self.lists.append((slice(None) if len(rows) == len(places) else rows, places[rows, pivot]))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule from a query with these pivots, nearest first; a vector that is not in a
        pivot's list counts as placed right behind the posted ones."""
        total = np.full(self.rows, int(np.abs(self.posted - np.arange(len(order))).sum()), dtype=np.int64)
        for place, pivot in enumerate(order):
            rows, places = self.lists[pivot]
            total[rows] += np.abs(places - place) - abs(self.posted - place)
        return total


def _search(pivots: dict[int, np.ndarray], longest: dict[int, float], posted: int, k: int, share: float):
    def lift(vectors: np.ndarray, length: float) -> np.ndarray:
        rest = np.sqrt(np.maximum(length**2 - (vectors * vectors).sum(axis=1), 0))
        return np.hstack([vectors, rest[:, None]])

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            width = queries.column("width")[0].as_py()
            ids = vectors.column("vec_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids, own = ids[by_id], _matrix(vectors.column("vector"))[by_id]
            lifted = lift(pivots[width], longest[width])
            files = InvertedFiles(places_of(lift(own, longest[width]), lifted), posted)
            asked = _matrix(queries.column("vector"))
            orders = np.argsort(places_of(asked, lifted[:, :-1]), axis=1)[:, :posted]
            n = min(len(ids), max(k + 1, int(np.ceil(share * len(ids)))))
            tie = np.arange(len(ids))
            for query, vector, order in zip(queries.column("vec_id").to_pylist(), asked, orders, strict=True):
                near = np.argpartition(files.footrule(order) * len(ids) + tie, n - 1)[:n]
                near = near[ids[near] != query]
                score = (own[near] * vector).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                out[0].append(np.full(len(best), query))
                out[1].append(ids[near][best])
                out[2].append(score[best])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table(
            {
                "query_id": pa.array(flat[0].astype(np.int64)),
                "vec_id": pa.array(flat[1].astype(np.int64)),
                "score": pa.array(flat[2].astype(np.float64)),
            }
        )

    return search


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = K,
    n_pivots: int = PIVOTS,
    posted: int | None = None,
    share: float = CANDIDATE_SHARE,
    least: int = LEAST_CANDIDATES,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that ``is_query``."""
    vectors = table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.size("embedding").alias("width"),
        F.col("embedding").cast("array<double>").alias("vector"),
        is_query.alias("asks"),
    )
    vectors = written(vectors, "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = vectors.groupBy("width").agg(F.count("*"), F.count_if("asks"), F.max(norm)).collect()
    n = sum(row[1] for row in sizes)
    asked = sum(row[2] for row in sizes)
    pivots = choose_pivots(vectors, n_pivots)
    n_blocks = max(1, -(-n // block_rows))
    n_batches = max(1, -(-asked // query_rows))
    share = min(1.0, max(share, least / max(n, 1)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")
    batch = F.pmod(F.xxhash64("vec_id", F.lit("batch")), F.lit(n_batches)).alias("batch")
    others = F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("batch")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    keys = ["width", "block", "batch"]
    posts = vectors.select("vec_id", "width", "vector", block, others).withColumn("batch", F.col("batch").cast("bigint"))
    asks = vectors.filter("asks").dropDuplicates(["vec_id"]).select("vec_id", "width", "vector", batch, all_blocks)
    asks = asks.withColumn("block", F.col("block").cast("bigint"))
    longest = {row[0]: float(row[3]) for row in sizes}
    search = _search(pivots, longest, min(posted or n_pivots, n_pivots), k, share)
    found = (
        asks.groupBy(*keys)
        .cogroup(posts.groupBy(*keys))
        .applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    )
    ranked = top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, "rank")
    return ranked.select("query_id", "rank", "vec_id", "score")
