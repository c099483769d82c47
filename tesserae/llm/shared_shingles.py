"""Components of texts of a Jaccard similarity, through shared rare shingles.

Put the shingles of all texts into one order. Two sets of a similarity of at least ``s`` then share
one of the first ``n - ceil(s n) + 1`` shingles of each (the prefix), whatever the order is. The order
puts shingles that are frequent in a sample last, which only keeps groups short.

1. Every text is read once, and leaves its number of shingles, its prefix and a sketch. (shingle, text)
   rows are sorted by shingle, and texts that share one become a group. Of groups with the same
   texts one is enough; groups of more than ``limit`` texts are cut into blocks by size, and blocks
   whose sizes allow similar texts meet each other.
2. Two texts may meet in many groups; the one of their least common shingle compares them, and the
   others leave them out. Within a group pairs are compared by their sketches: bit ``h`` of a sketch is the parity of
   the shingles with that hash, so two sketches differ in no more bits than the sets in
   shingles. A pair beyond ``(1 - s) / (1 + s)`` of both sizes is no link for certain; the few others are
   candidates, of which a group hands on a spanning forest first.
3. Candidates are verified on the texts: one per text at first, then those whose ends are still
   in different components. Groups that had more candidates than their forest, and still have texts of
   several components, hand on more of them in each round until they have handed on all that
   lead to another component. Only verified links join components.

So no link is lost and none is guessed, at any ``limit``. A text without words has one shingle, the
empty one; one of fewer words than a shingle has one shingle of all its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch, small, word_runs
from tesserae.llm.graph import components

SAMPLE_TEXTS = 2_000
#: Frequent shingles that are known; the others come first, which is right in any case.
SAMPLE_SHINGLES = 100_000
#: Texts and groups that a task remembers, to hand each on once. A copy from another task is harmless.
REMEMBERED = 200_000
LEAST_BITS = 64
#: Groups of so few texts are compared as Python numbers, larger ones as matrices.
FEW = 12
#: After its forest, a group hands on so many candidates per text, and then times more each round.
PER_TEXT = 4
ROWS_AT_ONCE = 500_000

_ODD = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> set[bytes]:
    found: set[bytes] = set()
    for run in word_runs(text, keep=width - 1):
        found.update(b" ".join(run[i : i + width]) for i in range(max(1, len(run) - width + 1)))
    return found


def jaccard(a: str | None, b: str | None, width: int) -> float:
    return _jaccard(shingle_set(a, width), shingle_set(b, width))


def _jaccard(left: set[bytes], right: set[bytes]) -> float:
    both = len(left & right)
    return both / (len(left) + len(right) - both) if left or right else 1.0


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD[0]
    return values ^ (values >> np.uint64(29))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, made from one hash per word."""
    found = []
    for run in word_runs(text, keep=width - 1):
        words = np.fromiter(map(xxhash.xxh64_intdigest, run), dtype=np.uint64, count=len(run))
        size = min(width, len(run))
        grams = np.full(len(run) - size + 1, size, dtype=np.uint64)
        for j in range(size):
            grams += _mixed(words[j : j + len(grams)]) * _ODD[j + 1]
        found.append(_mixed(grams))
    return np.unique(np.concatenate(found) if found else np.zeros(1, dtype=np.uint64)).view(np.int64)


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set by (count in the sample, hash)."""
    keep = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[:keep]]


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes' low bits, with at least one bit per hash; the number of bits is a
    power of two, and xor of both halves is the sketch of half as many bits."""
    bits = max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length())
    places = (hashes.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, and in how many; both in order of hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(text, width))], names=["token"])

    every = max(1, texts.count() // SAMPLE_TEXTS)
    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).dropDuplicates(["node"]).select("text")
    counts = sample.mapInArrow(scan, "token bigint").groupBy("token").count().filter("count > 1")
    rows = sorted(counts.orderBy(F.desc("count"), "token").limit(SAMPLE_SHINGLES).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def _signed(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, size, sketch, tokens) of texts (node, text); a node may come from several tasks."""
    common, counts = _frequent(texts, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in known:
                    continue
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(node)
                hashes = shingle_hashes(text.as_py(), width)
                rows.append((node, len(hashes), sketch(hashes), prefix(hashes, common, counts, similarity)))
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "size", "sketch", "tokens"])

    return texts.select("node", "text").mapInArrow(scan, "node bigint, size bigint, sketch binary, tokens array<bigint>")


class _Groups:
    """Groups (token, block, number of texts, two marks, sizes, nodes) of rows in order."""

    NAMES = ("token", "block", "n", "mark", "mark2", "low", "high", "nodes")
    SCHEMA = "token bigint, block bigint, n bigint, mark bigint, mark2 bigint, low bigint, high bigint, nodes array<bigint>"

    def __init__(self, limit: int):
        self.limit, self.known = limit, set()
        self.token, self.node, self.size = (np.zeros(0, dtype=np.int64) for _ in range(3))
        # Blocks that have left of the group that is still open, and its last text.
        self.blocks, self.last = 0, None

    def add(self, token: np.ndarray, size: np.ndarray, node: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        token, size, node = (np.concatenate(p) for p in ((self.token, token), (self.size, size), (self.node, node)))
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, size, node = token[fresh], size[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, dtype=np.int64)
        stops = np.append(starts[1:], len(token))
        rows = []
        for i in np.flatnonzero((stops - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)).tolist():
            start, stop, open_ = int(starts[i]), int(stops[i]), i == len(starts) - 1 and not end
            while stop - start > self.limit:
                rows.append((token[start], self.blocks, node[start : start + self.limit], size[start : start + self.limit]))
                start, self.blocks = start + self.limit, self.blocks + 1
            if open_:
                self.token, self.size, self.node = token[start:], size[start:], node[start:]
            elif stop - start > 1 or self.blocks:
                rows.append((token[start], self.blocks, node[start:stop], size[start:stop]))
            if not open_:
                self.blocks = 0
        if end or not len(starts):
            self.token, self.size, self.node = (np.zeros(0, dtype=np.int64) for _ in range(3))
        if rows:
            yield from self._made(rows)

    def _made(self, rows: list) -> Iterator[pa.RecordBatch]:
        offsets = np.cumsum([0, *(len(r[2]) for r in rows)])
        nodes = np.concatenate([r[2] for r in rows])
        hashed = _mixed(nodes.view(np.uint64))
        marks = [np.bitwise_xor.reduceat(h, offsets[:-1]).view(np.int64) for h in (hashed, _mixed(hashed * _ODD[7]))]
        keep = []
        for i, row in enumerate(rows):
            mark = (int(marks[0][i]), int(marks[1][i]), len(row[2]))
            if not row[1] and len(row[2]) < self.limit:
                if mark in self.known:
                    continue
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known.add(mark)
            keep.append(i)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nodes))
        take = pa.array(keep, type=pa.int64())
        columns = [
            pa.array([int(r[0]) for r in rows], type=pa.int64()),
            pa.array([r[1] for r in rows], type=pa.int64()),
            pa.array([len(r[2]) for r in rows], type=pa.int64()),
            pa.array(marks[0]),
            pa.array(marks[1]),
            pa.array([int(r[3][0]) for r in rows], type=pa.int64()),
            pa.array([int(r[3][-1]) for r in rows], type=pa.int64()),
            lists,
        ]
        yield pa.RecordBatch.from_arrays([c.take(take) for c in columns], names=list(self.NAMES))


def _grouped(signed: DataFrame, limit: int) -> DataFrame:
    """Blocks of texts that share a shingle of their prefixes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(limit)
        for batch in batches:
            yield from groups.add(*(batch.column(i).to_numpy() for i in range(3)), end=False)
        yield from groups.add(*(np.zeros(0, dtype=np.int64) for _ in range(3)), end=True)

    rows = signed.select(F.explode("tokens").alias("token"), "size", "node")
    ordered = rows.repartition("token").sortWithinPartitions("token", "size", "node")
    return ordered.mapInArrow(scan, _Groups.SCHEMA)


def _units(blocks: DataFrame, similarity: float) -> DataFrame:
    """(unit, part, node): texts to compare with each other, within a block or of two blocks."""
    sets = blocks.groupBy("token").agg(
        F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.bit_xor("mark2").alias("mark2"), F.max("block").alias("blocks")
    )
    chosen = sets.groupBy("n", "mark", "mark2", "blocks").agg(F.min("token").alias("token"))
    kept = blocks.join(chosen.filter("n > 1").select("token", "blocks"), "token")
    own = kept.select(F.struct("token", F.col("block").alias("x"), F.col("block").alias("y")).alias("unit"), F.lit(0).alias("part"), "nodes")
    hot = kept.filter("blocks > 0")
    earlier = hot.select("token", F.col("block").alias("x"), "high", "nodes")
    later = hot.select("token", F.col("block").alias("y"), F.col("low").alias("low2"), F.col("nodes").alias("nodes2"))
    # Blocks are in order of size.
    met = earlier.join(later, "token").filter((F.col("x") < F.col("y")) & (F.col("low2") * similarity <= F.col("high") + 1e-9))
    unit = F.struct("token", "x", "y").alias("unit")
    sides = F.array(F.struct(F.lit(0).alias("part"), "nodes"), F.struct(F.lit(1).alias("part"), F.col("nodes2").alias("nodes")))
    cross = met.select(unit, F.explode(sides).alias("s")).select("unit", "s.part", "s.nodes")
    return own.unionByName(cross).select("unit", "part", F.explode("nodes").alias("node"))


class _Unit:
    """Texts of one unit, in order of size, and which pairs of them may be similar."""

    def __init__(self, members: list[dict], similarity: float):
        members = sorted(members, key=lambda m: (m["size"], m["node"]))
        self.node = [m["node"] for m in members]
        self.part = np.array([m["part"] for m in members])
        self.root = np.array([m["root"] for m in members])
        self.size = np.array([m["size"] for m in members])
        self.sketches = [m["sketch"] for m in members]
        self.earlier = [m["earlier"] for m in members]
        # Which texts have an earlier shingle, that is, meet in the group of that as well.
        self.having: dict[int, list[int]] = {}
        for i, tokens in enumerate(self.earlier):
            for token in tokens:
                self.having.setdefault(token, []).append(i)
        self.similarity = similarity
        self.share = (1 - similarity) / (1 + similarity)

    def _own(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others do not meet text i in the group of an earlier shingle."""
        for token in self.earlier[i]:
            if not len(others):
                break
            if len(self.having[token]) > 1:
                met = np.zeros(len(self.node), dtype=bool)
                met[self.having[token]] = True
                others = others[~met[others]]
        return others

    def _near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others, as large as text i or larger, may be similar to it."""
        if not len(others):
            return others
        own, rows = self.sketches[i], []
        if len(self.size) <= FEW:
            value, bits = int.from_bytes(own, "little"), 8 * len(own)
            for j in others.tolist():
                other, wide = int.from_bytes(self.sketches[j], "little"), 8 * len(self.sketches[j])
                while wide > bits:
                    wide //= 2
                    other = (other >> wide) ^ (other & ((1 << wide) - 1))
                rows.append((value ^ other).bit_count())
            apart = np.array(rows)
        else:
            apart = np.concatenate([np.bitwise_count(m ^ np.frombuffer(own, dtype=np.uint64)).sum(axis=1, dtype=np.int64) for m in self._matrices(len(own), others)])
        return others[apart <= self.share * (self.size[i] + self.size[others]) + 1e-9]

    def _matrices(self, width: int, others: np.ndarray) -> Iterator[np.ndarray]:
        """Sketches of a range of texts, folded to ``width`` bytes."""
        if not hasattr(self, "rows"):
            lengths = np.array([len(s) for s in self.sketches])
            self.first = {int(n): int(np.flatnonzero(lengths == n)[0]) for n in np.unique(lengths)}
            self.last = {int(n): int(np.flatnonzero(lengths == n)[-1]) + 1 for n in np.unique(lengths)}
            self.rows = {
                n: np.frombuffer(b"".join(self.sketches[self.first[n] : self.last[n]]), dtype=np.uint64).reshape(-1, n // 8)
                for n in self.first
            }
            self.folded = {}
        start, stop = int(others[0]), int(others[-1]) + 1
        chosen = others - start
        for n in sorted(self.first):
            low, high = max(start, self.first[n]), min(stop, self.last[n])
            if low >= high:
                continue
            if (n, width) not in self.folded:
                rows = self.rows[n]
                while rows.shape[1] * 8 > width:
                    half = rows.shape[1] // 2
                    rows = rows[:, :half] ^ rows[:, half:]
                self.folded[n, width] = rows
            inside = chosen[(others >= low) & (others < high)] + start - self.first[n]
            yield self.folded[n, width][inside]

    def candidates(self, per_text: int) -> tuple[list[tuple[int, int]], bool]:
        """Pairs of texts of different roots that may be similar, and whether these are all: a spanning
        forest, and up to ``per_text`` pairs for each text besides."""
        n, cross = len(self.node), bool(self.part.any())
        # Texts that the pairs so far connect have the same label.
        labels = np.arange(n)
        found: list[tuple[int, int]] = []
        extra, whole = 0, True
        for i in range(n):
            stop = int(np.searchsorted(self.size, self.size[i] / self.similarity + 1e-9, side="right"))
            others = np.arange(i + 1, stop)
            allowed = self.root[others] != self.root[i]
            if cross:
                allowed &= self.part[others] != self.part[i]
            others = self._own(i, others[allowed])
            if not per_text:
                # Only a forest is asked for: texts that are connected already are not even compared.
                apart = others[labels[others] != labels[i]]
                whole &= len(apart) == len(others)
                others = apart
            near = self._near(i, others)
            if not len(near):
                continue
            theirs = labels[near]
            new, first = np.unique(theirs, return_index=True)
            first = first[new != labels[i]]
            merged = np.append(theirs[first], labels[i])
            labels[np.isin(labels, merged)] = merged.min()
            rest = np.setdiff1d(np.arange(len(near)), first)
            more = rest[: max(0, per_text * n - extra)]
            extra += len(more)
            whole &= len(more) == len(rest)
            found += [(self.node[i], self.node[j]) for j in near[np.concatenate([first, more])].tolist()]
        return found, whole


def _described(signed: DataFrame, units: DataFrame) -> DataFrame:
    """(node, size, sketch, shared) of the texts of units; shared are the shingles whose groups have them."""
    own = units.filter("unit.x = unit.y").groupBy("node").agg(F.collect_set("unit.token").alias("shared"))
    return signed.select("node", "size", "sketch").dropDuplicates(["node"]).join(own, "node")


def _candidates(
    units: DataFrame, info: DataFrame, roots: DataFrame | None, similarity: float, per_text: int
) -> DataFrame:
    """(a, b) pairs that may be similar, and units (unit, with a and b null) that have more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        again: list[dict] = []

        def flush() -> pa.RecordBatch:
            a = [min(p) for p in pairs] + [None] * len(again)
            b = [max(p) for p in pairs] + [None] * len(again)
            unit = [None] * len(pairs) + again
            kind = pa.struct([("token", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
            batch = pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(unit, kind)], names=["a", "b", "unit"]
            )
            pairs.clear()
            again.clear()
            return batch

        for batch in batches:
            for unit, members in zip(batch.column(0), batch.column(1), strict=True):
                found, whole = _Unit(members.as_py(), similarity).candidates(per_text)
                pairs.extend(found)
                if not whole:
                    again.append(unit.as_py())
                if len(pairs) > ROWS_AT_ONCE:
                    yield flush()
        if pairs or again:
            yield flush()

    earlier = F.filter("shared", lambda token: token < F.col("unit.token"))
    members = units.join(info, "node").withColumn("earlier", earlier)
    if roots is None:
        members = members.withColumn("root", F.col("node"))
    else:
        members = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = members.groupBy("unit").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        members = members.join(split.select("unit"), "unit", "left_semi")
    row = F.struct("node", "part", "size", "root", "sketch", "earlier")
    gathered = members.groupBy("unit").agg(F.collect_list(row).alias("members"))
    return gathered.mapInArrow(scan, "a bigint, b bigint, unit struct<token: bigint, x: bigint, y: bigint>")


def _alike_in_size(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose numbers of shingles allow the similarity."""
    sizes = signed.select("node", "size").dropDuplicates(["node"])
    for end in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}")), end)
    allowed = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9
    return pairs.filter(allowed).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of texts (node, text) whose shingle sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            last: list = [None, None, None, None]
            found = []
            for a, b in zip(left, right, strict=True):
                # A text is often that of the row before.
                if last[0] != a:
                    last[:2] = a, shingle_set(a, width)
                if last[2] != b:
                    last[2:] = b, shingle_set(b, width)
                found.append(_jaccard(last[1], last[3]) >= similarity)
            yield pd.Series(found, dtype=bool)

    ends = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    mine = scratch.written(texts.join(small(ends), "node", "left_semi").dropDuplicates(["node"]), "texts")
    left = mine.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = mine.select(F.col("node").alias("b"), F.col("text").alias("right"))
    near = pairs.join(left, "a").join(right, "b").filter(similar("left", "right")).select("a", "b")
    return scratch.written(near, "verified")


def similar_components(
    texts: DataFrame, width: int, similarity: float, limit: int, scratch: Scratch, given: DataFrame | None = None
) -> DataFrame:
    """(node, root) of the components of all pairs of texts (node, text) that are similar;
    nodes without a link are left out. Rows of a node have the same text.

    ``given``, a written table of pairs (a, b) with a below b, are candidates that were found otherwise. They
    are verified before all others, and what they connect is not verified again.
    """

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            named = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            pairs = pairs.join(named, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
        return pairs.filter("root_a <> root_b").select("a", "b")

    signed = scratch.written(_signed(texts, width, similarity), "signed")
    links, roots = [], None
    if given is not None:
        alike = scratch.written(_alike_in_size(given, signed, similarity), "alike")
        links = [_verified(alike, texts, width, similarity, scratch)]
        roots = scratch.written(components(links[0], scratch), "roots")
    blocks = scratch.written(_grouped(signed, limit), "blocks")
    units = scratch.written(_units(blocks, similarity), "units")
    info = scratch.written(_described(signed, units), "info")
    found = scratch.written(_candidates(units, info, None, similarity, 0), "candidates")
    pairs = found.filter("a IS NOT NULL").select("a", "b").distinct()
    if roots is not None:
        pairs = apart(pairs.join(given, ["a", "b"], "left_anti"), roots)
    pairs = scratch.written(pairs, "pairs")
    # One link of each text to the least text before it joins most of a group.
    first = scratch.written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links.append(_verified(first, texts, width, similarity, scratch))
    roots = scratch.written(components(reduce(DataFrame.unionByName, links), scratch), "roots")
    rest = scratch.written(apart(pairs.join(first, ["a", "b"], "left_anti"), roots), "rest")
    links.append(_verified(rest, texts, width, similarity, scratch))
    roots = scratch.written(components(reduce(DataFrame.unionByName, links), scratch), "roots")
    checked, per_text = pairs if given is None else pairs.unionByName(given), PER_TEXT
    while True:
        again = scratch.written(found.filter("unit IS NOT NULL").select("unit"), "again")
        if not again.take(1):
            return roots
        left = scratch.written(units.join(small(again), "unit", "left_semi"), "left")
        found = scratch.written(_candidates(left, info, roots, similarity, per_text), "candidates")
        more = found.filter("a IS NOT NULL").select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
        more = scratch.written(more, "more")
        links.append(_verified(more, texts, width, similarity, scratch))
        roots = scratch.written(components(reduce(DataFrame.unionByName, links), scratch), "roots")
        checked, per_text = checked.unionByName(more), per_text * PER_TEXT
