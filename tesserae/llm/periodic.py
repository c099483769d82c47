"""Periodic runs of words, by internal pattern matching.

A run is a stretch of words with smallest period ``q``, at least ``least`` words and two periods
long, that no neighbouring word extends. Many texts are searched at once, as one sequence of
word numbers in which every text ends with a number of its own.

* Only words in a sequence of six that a text repeats can belong to a run (a run of 12 words or
  more repeats at least half of itself), so other words are replaced by an end number. This
  is found with 64-bit hashes; a collision only keeps words that are not needed.
* Naming all blocks of 1, 2, 4, ... words gives the suffix array and the length of any common
  extension in a few steps.
* A run of period ``q`` has an aligned block of about ``q / 2`` words that occurs again ``q``
  words later. For every aligned (dyadic) block, its occurrences in the window behind it are
  visited by range successor queries to a wavelet matrix over the suffix array.
* Occurrences at most half a block apart are a progression: they lie in one stretch whose period
  is their distance ``d``. Such a progression is left in one step. Let the block's own
  ``d``-periodic stretch be ``[l, r)``, the later one ``[l2, r2)``, and the run ``[s, e)`` of
  period ``q`` (a member of the progression, so its residue modulo ``d`` is known). If a stretch
  starts inside the run, both start ``q`` apart; likewise for ends. Otherwise the run's borders
  cut one stretch on each side, and ``q`` is the only member in ``(r2 - r, r2 - l2]``, the only one in
  ``(l2 - l, r - l]``, the least one above both shifts ``l2 - l`` and ``r2 - r``, or, where the
  stretches meet, any one below both shifts; each of the last is a run of its own.
* Candidates are extended as far as the period holds, kept if long enough, and of equal
  stretches the smallest period stays. The result is exact.

Results per row: null and empty texts have no words, no runs and an empty collapsed text. Repeated
rows and repeated or null ids are read row by row. An empty table gives no rows. Columns other than
id and text are not read. A text of any length is read whole; memory grows with the part of it
that repeats, about a hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Shortest run that the search is built for: half of it is the sequence that must repeat.
LEAST = 12
GRAM = LEAST // 2
#: Texts are searched together up to so many words; a longer one is searched alone.
WORDS_AT_ONCE = 400_000
#: Collapsed texts leave in batches of about this size.
BYTES_AT_ONCE = 1 << 23
FILTER_BITS = 22
#: Aligned blocks begin at this level (blocks of four words, every second word).
FIRST_LEVEL = 2

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def block_names(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at every place, in their order, up to
    ``longest`` words. A block that reaches over the end is named after what is there."""
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while 2 * size <= longest:
        last = names[-1]
        follower = np.zeros_like(last)
        follower[: len(last) - size] = last[size:] + 1
        names.append(np.unique(last * (int(last.max()) + 2) + follower, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return names


def common_after(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places a and b on are equal. No two ends of the sequence are."""
    n, done = len(names[0]), np.zeros_like(a)
    for level in reversed(range(len(names))):
        going = np.arange(len(a))
        while len(going):
            x, y = a[going] + done[going], b[going] + done[going]
            going, x, y = (v[np.maximum(x, y) < n] for v in (going, x, y))
            going = going[names[level][x] == names[level][y]]
            done[going] += 1 << level
            if level < len(names) - 1:
                break
    return done


def common_before(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before places a and b are equal."""
    done = np.zeros_like(a)
    for level in reversed(range(len(names))):
        going = np.arange(len(a))
        while len(going):
            x, y = (v[going] - done[going] - (1 << level) for v in (a, b))
            going, x, y = (v[np.minimum(x, y) >= 0] for v in (going, x, y))
            going = going[names[level][x] == names[level][y]]
            done[going] += 1 << level
            if level < len(names) - 1:
                break
    return done


class WaveletMatrix:
    """Order statistics of ranges of a permutation of 0..n-1, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = list(reversed(range(max(1, (self.n - 1).bit_length()))))
        self.before: list[np.ndarray] = []
        for bit in self.bits:
            zero = (values >> bit) & 1 == 0
            self.before.append(np.concatenate(([0], np.cumsum(zero))))
            values = np.concatenate((values[zero], values[~zero]))

    def _below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        total = np.zeros_like(lo)
        for bit, before in zip(self.bits, self.before, strict=True):
            l0, h0, one = before[lo], before[hi], (x >> bit) & 1 == 1
            total += np.where(one, h0 - l0, 0)
            lo = np.where(one, before[-1] + lo - l0, l0)
            hi = np.where(one, before[-1] + hi - h0, h0)
        return total

    def _smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        value = np.zeros_like(lo)
        for bit, before in zip(self.bits, self.before, strict=True):
            l0, h0 = before[lo], before[hi]
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            lo = np.where(one, before[-1] + lo - l0, l0)
            hi = np.where(one, before[-1] + hi - h0, h0)
            value |= one.astype(value.dtype) << bit
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``x`` in each range [lo, hi); n if there is none."""
        out = np.full_like(lo, self.n)
        inside = np.flatnonzero(x < self.n)
        lo, hi, x = lo[inside], hi[inside], x[inside]
        skip = self._below(lo, hi, x)
        some = lo + skip < hi
        out[inside[some]] = self._smallest(lo[some], hi[some], skip[some])
        return out


def _candidates(names: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) pairs among which every run has one: the words at the place occur again
    a period later."""
    n = len(names[0])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    tree = WaveletMatrix(np.argsort(names[-1], kind="stable"))
    for level in range(FIRST_LEVEL, len(names)):
        block, reach = 1 << level, min(longest, 4 * (1 << level) - 2)
        counts = np.bincount(names[level])
        firsts = np.cumsum(counts) - counts
        at = np.arange(0, n - block + 1, block // 2 if level == FIRST_LEVEL else block)
        at = at[counts[names[level][at]] > 1]
        lo = firsts[names[level][at]]
        hi = lo + counts[names[level][at]]
        last = at.copy()
        while len(at):
            found = tree.successor(lo, hi, last + 1)
            near = found <= np.minimum(at + reach, n - 1)
            at, lo, hi, found = at[near], lo[near], hi[near], found[near]
            pairs.append((at, found - at))
            later = tree.successor(lo, hi, found + 1)
            step = later - found
            several = np.flatnonzero((step <= block // 2) & (later < n))
            last = found.copy()
            if not len(several):
                continue
            i, x, d = at[several], found[several], step[several]
            l1, r1 = i - common_before(names, i, i + d), i + d + common_after(names, i, i + d)
            l2, r2 = x - common_before(names, x, x + d), x + d + common_after(names, x, x + d)
            apart = x - i
            # Meeting stretches: the run may end with them on neither side, at any distance
            # below both shifts.
            most = np.minimum(np.minimum(l2 - l1, r2 - r1) - 1, reach)
            times = np.where(r1 >= l2, np.maximum(0, (most - apart) // d + 1), 0)
            which = np.repeat(np.arange(len(i)), times)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            pairs.append((i[which], apart[which] + turn * d[which]))
            over = np.maximum(l2 - l1, r2 - r1) + 1
            for period in (
                l2 - l1,
                r2 - r1,
                r2 - l2 - (r2 - l2 - apart) % d,
                r1 - l1 - (r1 - l1 - apart) % d,
                over + (apart - over) % d,
            ):
                fits = (period >= 1) & (period <= reach) & (i + period < n)
                pairs.append((i[fits], period[fits]))
            last[several] = x + (r2 - block - x) // d * d
    if not pairs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, period = (np.concatenate(side) for side in zip(*pairs, strict=True))
    distinct = np.unique(at * np.int64(n) + period)
    return distinct // n, distinct % n


def maximal_runs(words: np.ndarray, longest: int, least: int = LEAST) -> Runs:
    """(start, length, period) of all runs of a sequence whose texts end with numbers of their
    own; ``longest`` is the length of its longest text."""
    names = block_names(words, max(1 << FIRST_LEVEL, longest // 4 + 1))
    at, period = _candidates(names, max(1, longest // 2))
    start = at - common_before(names, at, at + period)
    end = at + period + common_after(names, at, at + period)
    long = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def _repeated(texts: list[list[bytes]]) -> list[np.ndarray | None]:
    """For each text which of its words are in a sequence of ``GRAM`` words that it repeats."""
    sizes = np.array([len(words) for words in texts])
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    hashes = np.fromiter((hash(w) for words in texts for w in words), dtype=np.int64, count=total).view(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    grams = np.zeros(max(0, total - GRAM + 1), dtype=np.uint64)
    odd = np.random.default_rng(5).integers(1, 1 << 63, GRAM + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(GRAM):
        grams += (hashes[j : j + len(grams)] ^ (hashes[j : j + len(grams)] >> np.uint64(29))) * odd[j]
    grams += text[: len(grams)].astype(np.uint64) * odd[GRAM]
    at = np.flatnonzero(text[: len(grams)] == text[GRAM - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    slot = ((grams[at] * odd[0]) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    at = at[np.bincount(slot, minlength=1 << FILTER_BITS)[slot] > 1]
    order = np.argsort(grams[at], kind="stable")
    ranked = grams[at][order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(at), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    change = np.zeros(total + 1, dtype=np.int32)
    starts = at[order[again]]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + GRAM, -1)
    covered = np.cumsum(change[:-1]) > 0
    parts = np.split(covered, ends[:-1])
    return [part if part.any() else None for part in parts]


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[Runs | None]:
    """The runs of each text, by start and period; None if it has none."""
    found: list[Runs | None] = [None] * len(texts)
    if not any(texts):
        return found
    numbers: dict[bytes, int] = {}
    sequence: list[np.ndarray] = []
    owners, places, longest, end_number = [], [], 0, -1
    for index, (words, covered) in enumerate(zip(texts, _repeated(texts), strict=True)):
        if covered is None:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < least:
                continue
            ids = [numbers.setdefault(w, len(numbers)) for w in words[start:end]]
            sequence.append(np.array([*ids, end_number], dtype=np.int64))
            end_number -= 1
            owners.append(index)
            places.append(start)
            longest = max(longest, end - start)
    if not sequence:
        return found
    first = np.cumsum([0, *(len(s) for s in sequence)])
    start, length, period = maximal_runs(np.concatenate(sequence), longest, least)
    piece = np.searchsorted(first, start, side="right") - 1
    start = start - first[piece] + np.array(places, dtype=np.int64)[piece]
    owner = np.array(owners, dtype=np.int64)[piece]
    bounds = np.flatnonzero(np.diff(owner)) + 1
    for part in np.split(np.arange(len(owner)), bounds):
        if len(part):
            found[int(owner[part[0]])] = start[part], length[part], period[part]
    return found


def collapsed(words: list[bytes], runs: Runs | None) -> bytes:
    """The words, without those that lie in a run after its first period, joined by a space."""
    if runs is None:
        return b" ".join(words)
    start, length, period = runs
    change = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def find_runs(
    docs: DataFrame,
    least: int = LEAST,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, runs, collapsed) of documents (doc_id, text): the runs as structs (start, length,
    period) by start and period, and the text with each run cut to its first period.

    ``rewrite(doc_id, words)`` may replace a text's words first.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not searched")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            begin, at, words, size = 0, 0, [], 0
            while at < len(ids):
                data = texts[at].as_py() or b""
                own = data.split()
                words.append(rewrite(ids[at].as_py(), own) if rewrite else own)
                size += len(own)
                at += 1
                if size >= WORDS_AT_ONCE or at == len(ids):
                    yield from results(ids.slice(begin, at - begin), words)
                    begin, words, size = at, [], 0

    def results(ids: pa.Array, words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        found = runs_of_texts(words, least)
        begin, held, short = 0, 0, []
        for i, (own, runs) in enumerate(zip(words, found, strict=True)):
            short.append(collapsed(own, runs))
            held += len(short[-1])
            if held >= BYTES_AT_ONCE or i == len(words) - 1:
                part = [r if r is not None else (np.zeros(0, dtype=np.int64),) * 3 for r in found[begin : i + 1]]
                offsets = np.cumsum([0, *(len(r[0]) for r in part)]).astype(np.int32)
                fields = [pa.array(np.concatenate(side)) for side in zip(*part, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(run_type)))
                columns = [ids.slice(begin, len(part)), lists, pa.array(short, type=pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])
                begin, held, short = i + 1, 0, []

    schema = f"doc_id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
