"""Bounded-space packing of token sequences.

Documents are tokenised once. Of each, all full windows leave at once; the rest is an item that
is placed best-fit into one of ``OPEN_WINDOWS`` open windows of its partition. If none has room,
the fullest is emitted and a new one is opened; if more than ``SPARE`` ids are missing there, the
item is cut and its first part fills the window up. Windows that are still open at a partition's end
are merged in the same way with those of ``MERGE_PARTS`` neighbouring partitions, as items that
keep their content together.

A document's tokens are its ids and one end id. Null text counts as empty: its only id is the
end. Repeated rows and repeated or null ids are packed row by row, so each row has its pieces.
An empty table gives no pieces. Columns other than id and text are not read.

Ids are those of the ``tokenizers`` file. Where a file with the same vocabulary as ranks is given
as well, plain texts go through the faster library; texts with special tokens, rare scripts or
very long runs go through ``tokenizers``. Both give the same ids (held by a test).
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import worker_cache, written

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 64
MERGE_PARTS = 32
#: A window may leave with so many ids missing; beyond that an item is cut to fill it.
SPARE = 64
#: Pieces are handed on in batches of so many rows.
ROWS_AT_ONCE = 20_000

#: What the faster library may not treat like ``tokenizers``: letters beyond Latin and Greek,
#: and runs whose merging would take long.
UNUSUAL = re.compile("[^\u0000-Ͽ‐-⁄€]|[^ \n]{3000}|\\s{3000}")


def encoder(json_path: str, ranks_path: str | None = None, pattern: str | None = None):
    """text -> array of ids."""
    cache = worker_cache()
    if (found := cache.get(("encoder", json_path, ranks_path))) is not None:
        return found
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    specials = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    encode = slow
    if ranks_path:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in specials) or UNUSUAL.search(text):
                return slow(text)
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    cache["encoder", json_path, ranks_path] = encode
    return encode


class Windows:
    """Open windows of one partition. An item is (key, size); windows are emitted as
    (window number, [(key, offset)], fill)."""

    def __init__(self, limit: int, size: int = WINDOW) -> None:
        self.limit, self.size = limit, size
        self.open: list[list] = []
        self.made = 0

    def _best(self, size: int):
        """The open window with the least room of those that have room, or None."""
        able = [w for w in self.open if self.size - w[2] >= size]
        return max(able, key=lambda w: w[2]) if able else None

    def gap(self, size: int) -> int:
        """What the fullest window lacks if an item of this size makes it leave, else 0."""
        if size == self.size or len(self.open) < self.limit or self._best(size) is not None:
            return 0
        return self.size - max(w[2] for w in self.open)

    def add(self, key, size: int) -> list[list]:
        """Place an item; the windows that are emitted for it."""
        if size == self.size:
            self.made += 1
            return [[self.made - 1, [(key, 0)], size]]
        best, emitted = self._best(size), []
        if best is None:
            if len(self.open) == self.limit:
                emitted = [max(self.open, key=lambda w: w[2])]
                self.open.remove(emitted[0])
            best = [self.made, [], 0]
            self.made += 1
            self.open.append(best)
        best[1].append((key, best[2]))
        best[2] += size
        if best[2] == self.size:
            self.open.remove(best)
            emitted.append(best)
        return emitted


_PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "window bigint, offset bigint, fill bigint, closed boolean"
)
_NAMES = [part.split()[0] for part in _PIECES.split(", ")]


def _pack_partition(make_encoder, end_id: int, open_windows: int, with_ids: bool):
    names = [*_NAMES, "ids"] if with_ids else _NAMES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        part = TaskContext.get().partitionId() << 40
        windows = Windows(open_windows)
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = {"closed": pa.bool_(), "ids": pa.list_(pa.int64())}
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names
            )
            rows.clear()
            return batch

        def emit(window: list, closed: bool) -> None:
            number, pieces, fill = window
            rows.extend((*p[:5], part + number, offset, fill, closed, *p[5:]) for p, offset in pieces)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                total, start = len(ids), 0
                while start < total:
                    size = min(WINDOW, total - start)
                    gap = windows.gap(size)
                    piece = ids[start : start + (gap if gap > SPARE else size)]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), total)
                    if with_ids:
                        row = (*row, piece.astype(np.int64))
                    for full in windows.add(row, len(piece)):
                        emit(full, True)
                    start += len(piece)
                if len(rows) >= ROWS_AT_ONCE:
                    yield table()
        for window in windows.open:
            emit(window, False)
        yield table()

    return pack


def _merge(open_windows: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(open_windows)
        rows: list[tuple] = []
        for window, fill in sorted(zip(group["window"], group["fill"], strict=True), key=lambda w: (-w[1], w[0])):
            for done in windows.add(window, fill):
                rows += [(w, done[1][0][0], at) for w, at in done[1]]
        for done in windows.open:
            rows += [(w, done[1][0][0], at) for w, at in done[1]]
        return pd.DataFrame(rows, columns=["window", "sequence_id", "base"])

    return merge


def pack_documents(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""

    def make_encoder():
        return encoder(json_path, ranks_path, pattern)

    schema = _PIECES + (", ids array<bigint>" if with_ids else "")
    scan = _pack_partition(make_encoder, end_id, open_windows, with_ids)
    pieces = written(docs.select("doc_id", "text").mapInArrow(scan, schema), "pieces")
    # A window number holds its partition in the upper bits.
    left = pieces.filter("not closed and offset = 0").select("window", "fill")
    group = F.expr(f"shiftright(window, 40) div {MERGE_PARTS}").alias("part")
    places = left.groupBy(group).applyInPandas(
        _merge(open_windows), "window bigint, sequence_id bigint, base bigint"
    )
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    keep += ["ids"] if with_ids else []
    closed = pieces.filter("closed").withColumn("sequence_id", F.col("window")).select(*keep)
    merged = pieces.filter("not closed").join(written(places, "places"), "window")
    merged = merged.withColumn("offset", F.col("base") + F.col("offset")).select(*keep)
    return closed.unionByName(merged)


def sequences(pieces: DataFrame, pad_id: int = 0, size: int = WINDOW) -> DataFrame:
    """(sequence_id, ids, n_ids): the packed sequences of pieces with ids, padded to ``size``
    unless their length is a power of two."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"), F.sum("length").alias("n_ids")
    )
    exact = F.expr("bit_count(n_ids) = 1")
    padding = F.array_repeat(F.lit(pad_id).cast("bigint"), (F.lit(size) - F.col("n_ids")).cast("int"))
    return joined.withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", padding)))
