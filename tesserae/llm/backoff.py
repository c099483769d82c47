"""Language-model scores by a weighted backoff automaton.

Events are the training words, the end token and one token for all unknown words. States are
the training words and the start of a document; after an unknown word the automaton is in the
root. A state has one arc for each word (or the end) that followed it in training, with the
discounted probability, and a failure arc to the root whose weight is the mass left over. The
root has an arc for every training word, discounted too; the mass left there belongs to unknown
words. So the probabilities of all events after any state add up to one. One traversal from left
to right carries the state and adds log10 probabilities.

Counts cover every training document, of all words and of all pairs of neighbours. The tables are
never held whole. Texts become blocks of bounded size, each a list of its distinct words and a
path of word numbers. Twice a block deals what it holds to shards and is answered in the same
order: shards of words add their counts up and number them, shards of pairs add the counts of
pairs of such numbers up. So a pair travels as the step from the pair before it, and an answer as
a count. All pairs of a state are in one shard, or, of a frequent word, in a few.

Null text counts as empty: its only token is the end. Ids may be null or repeat; repeated rows
score alike. Without training documents every token is unknown, with probability one. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import word_runs, written

BLOCK_BYTES = 8 << 20
#: Bytes of text for each shard, and the fewest shards: small inputs are spread as well.
SHARD_BYTES, SHARDS = 32 << 20, 64
#: Tokens whose pairs are sorted or scored at once.
TOKENS_AT_ONCE = 1_000_000
#: Occurrences of a state for each shard that its pairs are dealt to.
STATE_TOKENS = 1_000_000
#: Taken off each pair count; the discount of the root is estimated from its counts.
DISCOUNT = 0.75
#: Counts that a state must gather before its own arcs weigh as much as the root's.
STRENGTH = 100
#: Pairs of numbers below this fit into 63 bits.
MOST_WORDS = 3_000_000_000


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed with their bytes of equal weight side by side."""
    planes = np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").reshape(n)


def pack_ascending(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=np.int64), *parts])


def parts_of(shard: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal shards."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    return list(zip([0, *cuts], [*cuts, len(shard)], strict=True)) if len(shard) else []


class _Block:
    """Documents as a path through the numbers of their words; 0 is the end of a document."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.path: list[np.ndarray] = []
        self.docs: list[tuple[int | None, bool, int]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, held_out: bool, text: str) -> None:
        number, n = self.number, 0
        for run in chain(word_runs(text), [[b""]]):
            self.path.append(np.array([number.setdefault(w, len(number)) for w in run], dtype=np.int32))
            n += len(run)
        self.docs.append((doc_id, held_out, n))
        self.bytes += len(text.encode()) + 16

    def row(self, block: int, shards: int) -> dict:
        """Words are numbered anew, by shard and then by bytes; each shard gets its own, with their
        counts in training documents."""
        words = pa.array(list(self.number)[1:], pa.binary())
        shard = np.fromiter((crc32(w) % shards for w in self.number if w), np.int64, len(words))
        order = pc.sort_indices(
            pa.table({"shard": shard, "word": words}), [("shard", "ascending"), ("word", "ascending")]
        ).to_numpy()
        renumbered = np.zeros(len(words) + 1, dtype=np.int64)
        renumbered[order + 1] = np.arange(1, len(words) + 1)
        path = renumbered[np.concatenate(self.path)]
        doc_ids, held_out, lengths = zip(*self.docs, strict=True)
        learnt = np.repeat(~np.array(held_out), lengths)
        counts = np.bincount(path[learnt], minlength=len(words) + 1)[1:]
        shard, words = shard[order], words.take(pa.array(order))
        asked = []
        for a, b in parts_of(shard):
            own = b" ".join(words[a:b].to_pylist())
            own = len(own).to_bytes(8, "little") + pa.compress(own, codec="zstd", asbytes=True)
            asked.append({"shard": int(shard[a]), "words": own, "counts": pack(counts[a:b])})
        return {
            "block": block,
            "doc_ids": doc_ids,
            "held_out": held_out,
            "lengths": lengths,
            "path": pack(path),
            "asked": asked,
        }


_ASKED = pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
_BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())),
        ("path", pa.binary()),
        ("asked", _ASKED),
    ]
)
_BLOCKS_DDL = (
    "block bigint, doc_ids array<bigint>, held_out array<boolean>, lengths array<bigint>, path binary, "
    "asked array<struct<shard: int, words: binary, counts: binary>>"
)


def text_blocks(shards: int, block_bytes: int):
    """Documents as blocks; a block is numbered by its task and its place in it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        mine = _Block()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
            for doc_id, held_out, text in zip(*columns, strict=True):
                mine.add(doc_id, held_out, text)
                if mine.bytes >= block_bytes:
                    yield pa.RecordBatch.from_pylist([mine.row(at, shards)], _BLOCKS)
                    at, mine = at + 1, _Block()
        if mine.docs:
            yield pa.RecordBatch.from_pylist([mine.row(at, shards)], _BLOCKS)

    return encode


_WORDS_DDL = (
    "block bigint, shard int, ranks binary, totals binary, "
    "distinct bigint, tokens bigint, kinds bigint, once bigint, twice bigint"
)


def tally_words(asked: pa.Table) -> pa.Table:
    """Answers each block with the ranks of its words among those of the shard and with their
    counts in training documents. The first row has the figures of the shard."""
    words = []
    for data in asked.column("words").to_pylist():
        own = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        words.append(pa.array(own.split(b" "), pa.binary()))
    found = pa.concat_arrays(words).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    ranks = rank[found.indices.to_numpy()]
    counts = join([unpack(c) for c in asked.column("counts").to_pylist()])
    totals = np.bincount(ranks, counts, minlength=len(order)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    rows = list(zip(ends - [len(w) for w in words], ends, strict=True))
    several = np.bincount(np.minimum(totals, 3), minlength=4)
    figures = [len(order), int(totals.sum()), int((totals > 0).sum()), int(several[1]), int(several[2])]
    return pa.table(
        {
            "block": asked.column("block"),
            "shard": asked.column("shard"),
            "ranks": pa.array([pack_ascending(ranks[a:b]) for a, b in rows], pa.binary()),
            "totals": pa.array([pack(totals[ranks[a:b]]) for a, b in rows], pa.binary()),
            **{
                name: pa.array([figure] + [0] * (len(rows) - 1), pa.int64())
                for name, figure in zip(("distinct", "tokens", "kinds", "once", "twice"), figures, strict=True)
            },
        }
    )


class Numbered:
    """A block whose words have their numbers and counts in the whole corpus. State i is its word
    i, and state k the start or the end of a document."""

    def __init__(self, row: dict, shards: int, most: int, ends: int) -> None:
        known = sorted(row["known"] or [], key=lambda part: part["shard"])
        ids = [1 + part["shard"] + shards * unpack_ascending(part["ranks"]) for part in known]
        self.ids = np.append(join(ids), 0)
        self.totals = np.append(join([unpack(part["totals"]) for part in known]), ends)
        self.k = len(self.ids) - 1
        self.width = self.k + 2
        path = unpack(row["path"])
        self.states = np.where(path == 0, self.k, path - 1).astype(np.int32)
        self.lengths = np.array(row["lengths"])
        self.learnt = np.repeat(~np.array(row["held_out"]), self.lengths)
        self.shards, self.most = shards, most

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Cells (``state * width + next state``) of all pairs, ascending, with their counts in
        training documents."""
        cells, counts = [], []
        for start in range(0, len(self.states), TOKENS_AT_ONCE):
            at = self.states[start : start + TOKENS_AT_ONCE].astype(np.int64)
            came = np.append(self.states[start - 1] if start else self.k, at[:-1])
            found, place = np.unique(came * self.width + at, return_inverse=True)
            cells.append(found)
            counts.append(np.bincount(place, self.learnt[start : start + TOKENS_AT_ONCE], minlength=len(found)))
        if len(cells) == 1:
            return cells[0], counts[0].astype(np.int64)
        found, place = np.unique(np.concatenate(cells), return_inverse=True)
        return found, np.bincount(place, np.concatenate(counts), minlength=len(found)).astype(np.int64)

    def dealt(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State, pair of corpus numbers and shard of each cell, and their order by shard and pair.

        The next words of a frequent state are dealt to several shards. A block asks all of them
        for the kinds of its arcs, by a pair of the state and no word at the end of the list.
        """
        state, after = cells // self.width, cells % self.width
        slices = 1 + self.totals // STATE_TOKENS
        asks = np.unique(state)
        asks = asks[slices[asks] > 1]
        every = np.repeat(asks, slices[asks])
        piece = join([np.arange(n) for n in slices[asks]])
        state, after = np.append(state, every), self.ids[after]
        piece = np.append(after % slices[state[: len(cells)]], piece)
        after = np.append(after, np.full(len(every), self.most))
        mixed = self.ids[state].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ piece.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        shard = ((mixed >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)
        pair = self.ids[state] * (self.most + 1) + after
        return state, pair, shard, np.lexsort((pair, shard))


def ask_pairs(shards: int, most: int, ends: int):
    """Pairs of each block with their counts in training documents, by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Numbered(row, shards, most, ends)
                cells, counts = block.pairs()
                _, pair, shard, order = block.dealt(cells)
                pair, shard = pair[order], shard[order]
                counts = np.append(counts, np.zeros(len(pair) - len(cells), dtype=np.int64))[order]
                parts = parts_of(shard)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(parts), pa.int64()),
                        pa.array([shard[a] for a, _ in parts], pa.int32()),
                        pa.array([pack_ascending(pair[a:b]) for a, b in parts], pa.binary()),
                        pa.array([pack(counts[a:b]) for a, b in parts], pa.binary()),
                    ],
                    names=["block", "shard", "pairs", "counts"],
                )

    return ask


def tally_pairs(most: int):
    """Answers each block with the counts of its pairs in training documents, and with the kinds of
    arcs that each of its states has in the shard."""

    def tally(asked: pa.Table) -> pa.Table:
        # Arrays of all pairs are dropped as soon as they can be.
        own = [unpack_ascending(p.as_py()) for p in asked.column("pairs")]
        ends = np.cumsum([len(mine) for mine in own])
        pairs = np.concatenate(own)
        del own
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        new = np.append(True, pairs[1:] != pairs[:-1])
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        pairs = pairs[new]
        counts = join([unpack(c.as_py()) for c in asked.column("counts")])
        totals = np.bincount(place, counts, minlength=len(pairs)).astype(np.int64)
        del counts
        new = np.append(True, np.diff(pairs // (most + 1)) != 0)
        kinds = np.add.reduceat(totals > 0, np.flatnonzero(new), dtype=np.int64)
        state = np.cumsum(new, dtype=np.int32) - 1
        answers, kinds_of = [], []
        for start, end in zip([0, *ends], ends, strict=False):
            here = place[start:end]
            answers.append(pack(totals[here]))
            mine = state[here]
            kinds_of.append(pack(kinds[mine[np.append(True, mine[1:] != mine[:-1])]]))
        return pa.table(
            {
                "block": asked.column("block"),
                "shard": asked.column("shard"),
                "totals": pa.array(answers, pa.binary()),
                "kinds": pa.array(kinds_of, pa.binary()),
            }
        )

    return tally


class Automaton:
    """Words as states over the root.

    Row k is the start of a document and row k + 1 the root; column k is the end token and
    column k + 1 stands for all unknown words. ``pairs`` is a table of counts, or the cells of
    such a table (``row * (k + 2) + column``, ascending) with their counts; ``kinds`` tells
    how many arcs a state has in all, if only some of them are given. A word without counts is
    a state without arcs, which is the same as the root.
    """

    def __init__(self, words: Sequence, context: np.ndarray, pairs, kinds: np.ndarray | None = None) -> None:
        k = len(words)
        self.width = k + 2
        if isinstance(pairs, np.ndarray):
            row, column = np.nonzero(pairs)
            pairs = row * self.width + column, pairs[row, column]
        self.cells, counts = pairs
        row = self.cells // self.width
        self.arcs = np.maximum(counts - DISCOUNT, 0) / (context + STRENGTH)[row]
        self.gamma = np.ones(k + 2)
        if kinds is None:
            self.gamma -= np.bincount(row, self.arcs, minlength=k + 2)
        else:
            # The counts of all arcs of a state add up to its own.
            self.gamma[: k + 1] -= (context - DISCOUNT * kinds) / (context + STRENGTH)

    def log_probabilities(self, states: np.ndarray, start: int, log_root: np.ndarray) -> np.ndarray:
        """log10 probability of each token, given the state that each leads to."""
        came = np.concatenate([[start], states[:-1]])
        alpha, gamma = np.zeros(len(states)), self.gamma[came]
        if len(self.cells):
            cell = came * self.width + states
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            alpha = np.where(self.cells[at] == cell, self.arcs[at], 0)
        with np.errstate(divide="ignore"):
            failed = np.log10(gamma) + log_root
            return np.where(alpha > 0, np.log10(alpha + gamma * 10.0**log_root), failed)


def block_automaton(block: Numbered, answers: list[dict]) -> Automaton:
    """The arcs and states that a block can reach."""
    cells, _ = block.pairs()
    state, pair, shard, order = block.dealt(cells)
    answers = sorted(answers, key=lambda part: part["shard"])
    counts = np.empty(len(pair), dtype=np.int64)
    counts[order] = join([unpack(part["totals"]) for part in answers])
    state, shard = state[order], shard[order]
    new = np.append(True, (state[1:] != state[:-1]) | (shard[1:] != shard[:-1]))
    here = join([unpack(part["kinds"]) for part in answers])
    kinds = np.bincount(state[new], here, minlength=block.k + 1).astype(np.int64)
    return Automaton(range(block.k), block.totals, (cells, counts[: len(cells)]), kinds)


def score_blocks(shards: int, most: int, ends: int, tokens: int, kinds: int, discount: float):
    """Scores the documents of blocks, given the answers for their words and pairs."""
    unknown = discount * kinds / tokens if tokens else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Numbered(row, shards, most, ends)
                automaton = block_automaton(block, row["answers"])
                counts = block.totals
                known = np.maximum(counts - discount, 0) / max(tokens, 1)
                log_root = np.log10(np.where(counts > 0, known, unknown))
                log_base = np.log10((counts + 1) / (tokens + kinds + 1))
                n_docs = len(block.lengths)
                base, total, n_known = np.zeros(n_docs), np.zeros(n_docs), np.zeros(n_docs, dtype=np.int64)
                document = np.repeat(np.arange(n_docs, dtype=np.int32), block.lengths)
                at = block.k
                for start in range(0, len(block.states), TOKENS_AT_ONCE):
                    states = block.states[start : start + TOKENS_AT_ONCE].astype(np.int64)
                    of = document[start : start + TOKENS_AT_ONCE]
                    # One by one, so that equal texts score alike wherever they are.
                    np.add.at(total, of, automaton.log_probabilities(states, at, log_root[states]))
                    np.add.at(base, of, log_base[states])
                    n_known += np.bincount(of, counts[states] > 0, minlength=n_docs).astype(np.int64)
                    at = int(states[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["held_out"], pa.bool_()),
                        pa.array(block.lengths, pa.int64()),
                        pa.array(n_known),
                        pa.array(np.full(n_docs, tokens, dtype=np.int64)),
                        pa.array(base),
                        pa.array(total),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


_SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def score_documents(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of documents (doc_id, text), learnt from those that are not held out."""
    texts = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size, ends = texts.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    shards = max(SHARDS, -(-(size or 0) // SHARD_BYTES))
    blocks = written(texts.mapInArrow(text_blocks(shards, block_bytes), _BLOCKS_DDL), "blocks")
    asked = blocks.select("block", F.inline("asked"))
    words = written(asked.groupBy("shard").applyInArrow(tally_words, _WORDS_DDL), "words")
    longest, n, kinds, once, twice = words.agg(
        F.max("distinct"), *[F.sum(c) for c in ("tokens", "kinds", "once", "twice")]
    ).first()
    discount = min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.0))
    tokens, kinds = (n or 0) + ends, (kinds or 0) + (ends > 0)
    most = 1 + shards * (longest or 0)
    if most > MOST_WORDS:
        raise ValueError(f"at most {MOST_WORDS} words can be numbered, these take {most}")
    known = words.groupBy("block").agg(F.collect_list(F.struct("shard", "ranks", "totals")).alias("known"))
    numbered = blocks.drop("asked").join(known, "block", "left")
    pairs = numbered.mapInArrow(
        ask_pairs(shards, most, ends), "block bigint, shard int, pairs binary, counts binary"
    )
    answers = pairs.groupBy("shard").applyInArrow(
        tally_pairs(most), "block bigint, shard int, totals binary, kinds binary"
    )
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "totals", "kinds")).alias("answers"))
    scorer = score_blocks(shards, most, ends, tokens, kinds, discount)
    return numbered.join(answers, "block").mapInArrow(scorer, _SCORES)
