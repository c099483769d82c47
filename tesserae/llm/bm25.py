"""Exact top-k search by BM25 over an inverted index with block-max pruning.

``build_index`` cuts the documents of every part into shards of bounded size, and writes one row
per shard and term: the documents in shard order, their term counts, and for every block of
``BLOCK`` neighbouring documents the largest count and the least length. These bounds hold for
any global statistics, so the index can be kept while the corpus grows.

``search`` takes document counts per term, the number of documents and their mean length over
the whole index, meets the postings of the query terms with the queries in every shard, and
runs each query there: blocks are visited by falling sum of their maxima, and none is opened
whose sum can't reach the k-th best score so far. The shards' best are merged; as all use the
same global statistics, the result is exact.

Contributions are rounded to ``UNIT`` before they are added, so that sums don't depend on their
order; ties go to the smaller id. Words are those between ASCII white space, A-Z in lower case.
Documents without an id take no part; null texts are documents without words. Documents that
share no word with a query are no result, so a query may have fewer than k. Repeated rows are
documents of their own. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import small, word_runs, written
from tesserae.operators.ranking import top_k

K1, B = 1.2, 0.75
K = 10
BLOCK = 128
UNIT = 1e-6
SHARD_DOCS = 8192
SHARD_WORDS = 2_000_000
QUERIES_AT_ONCE = 512
TERMS_AT_ONCE = 20_000
#: Blocks that are opened before the others are measured against the best found.
FIRST_BLOCKS = 4

_INDEX = (
    "shard bigint, term binary, docs array<int>, counts array<int>, blocks array<int>, "
    "most array<int>, least array<int>, ids array<bigint>, lengths array<int>"
)
_TYPES = {
    "shard": pa.int64(),
    "term": pa.binary(),
    **{name: pa.list_(pa.int32()) for name in ("docs", "counts", "blocks", "most", "least", "lengths")},
    "ids": pa.list_(pa.int64()),
}
_NAMES = [part.split()[0] for part in _INDEX.split(", ")]


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _shard_rows(shard: int, ids: list[int], runs: list[np.ndarray], owners: list[int], terms: list[bytes]):
    """Record batches of one shard: its document row, then its term rows."""
    sizes = [len(r) for r in runs]
    doc = np.repeat(np.array(owners, dtype=np.int64), sizes)
    term = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
    lengths = np.bincount(doc, minlength=len(ids))
    none = {name: pa.nulls(1, kind) for name, kind in _TYPES.items()}
    yield none | {
        "shard": pa.array([shard], pa.int64()),
        "ids": pa.array([ids], _TYPES["ids"]),
        "lengths": pa.array([lengths], _TYPES["lengths"]),
    }
    key, counts = np.unique(term * SHARD_DOCS + doc, return_counts=True)
    term, doc = key // SHARD_DOCS, key % SHARD_DOCS
    if not len(key):
        return
    cell = term * SHARD_DOCS + doc // BLOCK
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    most, least = np.maximum.reduceat(counts, starts), np.minimum.reduceat(lengths[doc], starts)
    blocks, block_term = doc[starts] // BLOCK, term[starts]
    for at in range(0, len(terms), TERMS_AT_ONCE):
        stop = min(len(terms), at + TERMS_AT_ONCE)
        edges = np.searchsorted(term, np.arange(at, stop + 1))
        cuts = np.searchsorted(block_term, np.arange(at, stop + 1))
        n = stop - at
        yield {
            "shard": pa.array(np.full(n, shard)),
            "term": pa.array(terms[at:stop], pa.binary()),
            "docs": _lists(edges - edges[0], doc[edges[0] : edges[-1]]),
            "counts": _lists(edges - edges[0], counts[edges[0] : edges[-1]]),
            "blocks": _lists(cuts - cuts[0], blocks[cuts[0] : cuts[-1]]),
            "most": _lists(cuts - cuts[0], most[cuts[0] : cuts[-1]]),
            "least": _lists(cuts - cuts[0], least[cuts[0] : cuts[-1]]),
            "ids": pa.nulls(n, _TYPES["ids"]),
            "lengths": pa.nulls(n, _TYPES["lengths"]),
        }


def _index_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId() << 32, count()

    def fresh():
        return [], [], [], defaultdict(count().__next__)

    def close():
        for columns in _shard_rows(part + next(number), ids, runs, owners, list(known)):
            yield pa.RecordBatch.from_arrays([columns[n] for n in _NAMES], names=_NAMES)

    ids, runs, owners, known = fresh()
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run in word_runs(text):
                runs.append(np.fromiter(map(known.__getitem__, run), dtype=np.int64, count=len(run)))
                owners.append(len(ids))
                held += len(run)
            ids.append(doc)
            if len(ids) == SHARD_DOCS or held >= SHARD_WORDS:
                yield from close()
                ids, runs, owners, known = fresh()
                held = 0
    if ids:
        yield from close()


def build_index(docs: DataFrame) -> DataFrame:
    """The written index of documents (doc_id, text)."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    return written(rows.mapInArrow(_index_part, _INDEX), "index")


def _impact(weight: float, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """Contribution in units; without documents of any length the norm is that of the mean."""
    norm = K1 * (1 - B + B * length / mean)
    return np.rint(weight * tf * (K1 + 1) / (tf + norm) / UNIT).astype(np.int64)


def best_in_shard(postings: list[tuple], lengths: np.ndarray, mean: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores in units, blocks opened) of a query's best in one shard.

    ``postings`` has per term: weight, docs, counts, blocks, most, least. All documents that
    tie with the k-th are returned.
    """
    n_blocks = -(-len(lengths) // BLOCK)
    bound = np.zeros(n_blocks, dtype=np.int64)
    for weight, _, _, blocks, most, least in postings:
        bound[blocks] += _impact(weight, most, least, mean)
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > 0]
    scores = np.zeros(len(lengths), dtype=np.int64)
    floor, at, step = 1, 0, FIRST_BLOCKS
    while at < len(order):
        now = order[at : at + step]
        now = now[bound[now] >= floor]
        if not len(now):
            break
        open_ = np.zeros(n_blocks, dtype=bool)
        open_[now] = True
        for weight, docs, counts, *_ in postings:
            mine = open_[docs // BLOCK]
            found = docs[mine]
            scores[found] += _impact(weight, counts[mine], lengths[found], mean)
        at += len(now)
        step *= 4
        if np.count_nonzero(scores) >= k:
            floor = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    found = np.flatnonzero(scores >= floor)
    return found, scores[found], at


_FOUND = "query_id bigint, doc_id bigint, units bigint"


def _search_shard(mean: float, k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        head = rows.filter(pa.compute.is_valid(rows.column("ids")))
        rows = rows.filter(pa.compute.is_valid(rows.column("term")))
        if queries.num_rows and rows.num_rows:
            ids = np.array(head.column("ids")[0].as_py(), dtype=np.int64)
            lengths = np.array(head.column("lengths")[0].as_py(), dtype=np.int64)
            lists = [
                [np.asarray(x, dtype=np.int64) for x in rows.column(n).to_pylist()]
                for n in ("docs", "counts", "blocks", "most", "least")
            ]
            place = {term: i for i, term in enumerate(rows.column("term").to_pylist())}
            asked = defaultdict(list)
            columns = [queries.column(n).to_pylist() for n in ("query_id", "term", "weight")]
            for query, term, weight in zip(*columns, strict=True):
                if (i := place.get(term)) is not None:
                    asked[query].append((weight, *(part[i] for part in lists)))
            for query, postings in asked.items():
                found, units, _ = best_in_shard(postings, lengths, mean, k)
                # Beyond k, ties only matter by the smaller id.
                best = np.lexsort((ids[found], -units))[:k]
                out[0].append(np.full(len(best), query))
                out[1].append(ids[found][best])
                out[2].append(units[best])
        return pa.table(
            {
                name: pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64), pa.int64())
                for name, c in zip(("query_id", "doc_id", "units"), out, strict=True)
            }
        )

    return search


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, repeats) of queries (query_id, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for query, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run in word_runs(text):
                    ids += [query] * len(run)
                    terms += run
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["query_id", "term"])

    rows = queries.filter("query_id is not null").select(F.col("query_id").cast("bigint"), "text")
    found = rows.mapInArrow(split, "query_id bigint, term binary")
    return found.groupBy("query_id", "term").agg(F.count("*").alias("repeats"))


def search(queries: DataFrame, index: DataFrame, k: int = K, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, doc_id, score) for queries (query_id, text)."""
    terms = written(query_terms(queries), "query-terms")
    heads = index.filter("ids is not null").select("shard", F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("words"))
    n, words = heads.agg(F.sum("n"), F.sum("words")).first()
    n, mean = n or 0, max((words or 0) / max(n or 0, 1), 1e-9)
    wanted = small(written(terms.select("term").distinct(), "wanted"))
    postings = index.filter("term is not null").join(wanted, "term")
    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    n_queries = terms.select("query_id").distinct().count()
    n_batches = max(1, -(-n_queries // queries_at_once))
    batch = F.pmod(F.xxhash64("query_id"), F.lit(n_batches)).cast("bigint").alias("batch")
    weighted = terms.join(written(df, "frequencies"), "term").select(
        "query_id", "term", (F.col("repeats") * idf).alias("weight"), batch
    )
    weighted = written(weighted, "weighted")
    batches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_batches - 1).cast("bigint"))).alias("batch")
    own = postings.join(small(written(weighted.select("term", "batch").distinct(), "batches")), "term").select("batch", *_NAMES)
    rows = own.unionByName(index.filter("ids is not null").select(batches, *_NAMES))
    shards = index.filter("ids is not null").select("shard")
    asks = weighted.join(small(written(shards, "shards")))
    found = asks.groupBy("batch", "shard").cogroup(rows.groupBy("batch", "shard")).applyInArrow(_search_shard(mean, k), _FOUND)
    ranked = top_k(found, ["query_id"], [F.col("units").desc(), F.col("doc_id")], k, "rank")
    return ranked.select("query_id", "rank", "doc_id", (F.col("units") * UNIT).alias("score"))
