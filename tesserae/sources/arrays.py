"""JSON arrays that are larger than a cell, read by many tasks.

The text source splits a file by bytes and cuts it at commas, so every task gets pieces of its
range. What a comma means depends on everything before it, but a range only needs to know two
things of that: whether it starts inside a string, and how deep. Each range therefore first tells,
for both cases, how it ends and by how much it goes deeper; a running composition over the few ranges
of a file, in order, gives the true start of each. A second pass cuts at the commas of depth one. An
element over several ranges is put together from its parts. A file of one range starts outside at depth
zero, so it is read by the second pass only. Positions count from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.runtime import require_empty, stable

ESCAPED = re.compile(r"\\.", re.DOTALL)
#: Elements are handed on in batches of about so many characters.
CHARS_AT_ONCE = 1 << 22


def ends(piece: str) -> tuple[tuple[bool, int], tuple[bool, int]]:
    """How a piece between commas ends, outside (0) or inside (1) of a string, and by how much it
    goes deeper: once if it starts outside, once if it starts inside of a string."""
    parts = (ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    flips = (len(parts) - 1) % 2 == 1

    def deeper(outside: list[str]) -> int:
        return sum(p.count("[") + p.count("{") - p.count("]") - p.count("}") for p in outside)

    return (flips, deeper(parts[0::2])), (not flips, deeper(parts[1::2]))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece, whether the range is the whole file) in the order of each range."""
    rows = spark.read.text(path, lineSep=",")
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Pieces in runs of one range."""
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[start] or blocks[i] != blocks[start]:
                yield files[start], blocks[start], values[start:i]
                start = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, ends inside, depth) for a start outside and inside of a string."""
    known: dict[tuple[str, int], list] = {}
    for file, block, pieces in _runs(batches):
        state = known.setdefault((file, block), [False, 0, True, 0])
        for piece in pieces:
            both = ends(piece)
            for at in (0, 2):
                inside, depth = both[state[at]]
                state[at] = inside
                state[at + 1] += depth
    rows = [(*key, *state) for key, state in known.items()]
    names = ["file", "block", "out_ends", "out_depth", "in_ends", "in_depth"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def _composed(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of one file, from what the ranges do."""
    inside, depth, rows = False, 0, []
    for r in ranges.sort_values("block").itertuples():
        rows.append((r.file, r.block, inside, depth))
        depth += r.in_depth if inside else r.out_depth
        inside = r.in_ends if inside else r.out_ends
    rows.append((ranges["file"].iloc[0], None, inside, depth))
    return pd.DataFrame(rows, columns=["file", "block", "inside", "depth"]).astype({"block": "Int64"})


class _Range:
    """Cuts the pieces of one range into parts of elements."""

    def __init__(self, block: int, inside: bool, depth: int):
        self.block, self.inside, self.depth = block, inside, depth
        self.n, self.parts, self.started = 0, [], False

    def add(self, piece: str) -> tuple[int, str] | None:
        """The part that ends before the piece, if there is one."""
        done = None
        if self.started or self.block:
            # A comma stands before the piece.
            if not self.inside and self.depth == 1:
                if self.parts:
                    done = (self.n, ",".join(self.parts))
                self.n, self.parts = self.n + 1, []
            elif not self.started:
                self.parts = [""]
        self.started = True
        self.inside, deeper = ends(piece)[self.inside]
        self.depth += deeper
        self.parts.append(piece)
        return done


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of elements: (file, block, n, open, text, broken), where ``n`` counts the range's commas
    of depth one before the part. The first and the last part of a range are ``open``; the last one of
    a whole file is ``broken`` if the array does not end there."""
    ranges: dict[tuple[str, int], _Range] = {}
    whole: set[tuple[str, int]] = set()
    rows: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        names = ["file", "block", "n", "open", "text", "broken"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        states = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True)
        starts = {}
        for file, block, inside, depth, alone in states:
            starts[file, block] = (inside, depth)
            if alone:
                whole.add((file, block))
        for file, block, pieces in _runs([batch]):
            if (file, block) not in ranges:
                ranges[file, block] = _Range(block, *starts[file, block])
            own = ranges[file, block]
            for piece in pieces:
                if (done := own.add(piece)) is not None:
                    rows.append((file, block, done[0], done[0] == 0, done[1], False))
                    size += len(done[1])
            if size > CHARS_AT_ONCE:
                yield made()
                size = 0
    for (file, block), own in ranges.items():
        broken = (file, block) in whole and (own.inside or own.depth != 0)
        rows.append((file, block, own.n, True, ",".join(own.parts), broken))
    yield made()


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, element) of files that hold one JSON array each, as JSON texts.

    A file that doesn't hold one array is an error; an empty array has no elements. An element must
    fit into a cell.
    """
    pieces = _pieces(spark, path)
    summary = "file string, block bigint, out_ends boolean, out_depth bigint, in_ends boolean, in_depth bigint"
    ranges = pieces.filter("NOT whole").select("file", "block", "value").mapInArrow(_summaries, summary)
    states = ranges.groupBy("file").applyInPandas(_composed, "file string, block bigint, inside boolean, depth bigint")
    states = stable(states)
    require_empty(states.filter("block IS NULL AND (inside OR depth <> 0)"), "JSON array without its end")
    # A row per range: as many as tasks that read the files.
    known = pieces.join(F.broadcast(states.filter("block IS NOT NULL")), ["file", "block"], "left").select(
        "file", "block", "value",
        F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("depth", F.lit(0)).alias("depth"), "whole",
    )
    found = "file string, block bigint, n bigint, open boolean, text string, broken boolean"
    parts = stable(known.mapInArrow(_elements, found))
    require_empty(parts.filter("broken").select("file"), "JSON array without its end")
    commas = parts.groupBy("file", "block").agg(F.max("n").alias("commas"))
    in_order = Window.partitionBy("file").orderBy("block")
    before = F.sum("commas").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    offsets = commas.withColumn("before", F.coalesce(before, F.lit(0))).withColumn(
        "last", F.sum("commas").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )
    placed = parts.join(F.broadcast(offsets.drop("commas")), ["file", "block"])
    placed = placed.withColumn("position", F.col("before") + F.col("n"))
    whole = placed.filter("NOT open").select("file", "position", "last", "text")
    listed = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = placed.filter("open").groupBy("file", "position", "last").agg(listed.alias("parts"))
    whole = whole.unionByName(
        joined.select("file", "position", "last", F.expr("array_join(transform(parts, p -> p.text), '')").alias("text"))
    )
    first, final = F.col("position") == 0, F.col("position") == F.col("last")
    head, tail = r"(?s)\A\x{FEFF}?\s*\[", r"(?s)\]\s*\z"
    text = F.when(first, F.regexp_replace("text", head, "")).otherwise(F.col("text"))
    text = F.when(final, F.regexp_replace(text, tail, "")).otherwise(text)
    element = F.regexp_replace(text, r"(?s)\A\s+|\s+\z", "")
    wrong = F.when((first & ~F.col("text").rlike(head)) | (final & ~F.col("text").rlike(tail)), "no JSON array")
    wrong = wrong.when((element == "") & (F.col("last") > 0), "JSON array with a comma too many")
    # Checked while it is read: an action of its own would read everything once more.
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), "file"))).otherwise(element)
    return whole.select("file", "position", checked.alias("element")).filter("element <> ''")
