"""Token counts by compiled finite-state transducers.

A cascade of two deterministic machines counts the tokens of a merge-based tokenizer with word
ends, without making them:

* the *splitter* reads characters by class (letter, number, white space, other, apostrophe and
  the letters that may follow one) and emits the borders of pre-tokens;
* the *counter* reads the bytes of a pre-token. Its states hold, for every place where a
  vocabulary entry may still be growing, how far it has grown, which token ends before it and
  how many tokens fewer or more that place has than the current one. A transition is annotated
  with the change of the token count. It is compiled when first used and kept by the worker.

The counter relies on a property of merge-based tokenizers: a sequence of tokens is the
encoding of its text if and only if each token encodes to itself and each pair of neighbours
encodes to that pair. So the token that ends at a place is the only entry that fits the one
before it.

White space brings the splitter back to its start, so the state map of a chunk of text is
constant behind its first white space. ``ChunkMap`` holds a map in this form: the head that
must be run from the state left of the chunk, the count of what is complete, and the tail whose
state is handed on. Maps compose associatively. Texts longer than ``SLICE_CHARS`` are cut into
slices anywhere, slices are mapped by different tasks, and their maps are composed by a prefix
scan in pairs.

Null texts count as empty: no bytes, no tokens. Repeated rows count alike. Other columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import worker_cache

LIMIT_TOKENS = 2048
SLICE_CHARS = 1 << 20
#: Compiled states and remembered words are dropped beyond these numbers and made anew.
MOST_STATES = 200_000
MOST_WORDS = 400_000

#: White space as the tokenizer sees it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
BLANKS = re.compile(f"[{BLANK}]+")
#: What Python's own split takes for white space beyond that.
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable characters
    stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Splitter:
    """Splits a text without white space into pre-tokens by classes of characters."""

    START, LETTERS, OTHERS, MARK, PENDING = range(5)
    #: Letters that complete a token after an apostrophe, alone or in pairs.
    SINGLE = "stmd"
    PAIRS = {"r": "e", "v": "e", "l": "l"}

    def __init__(self) -> None:
        self.kinds: dict[str, int] = {}

    def kind(self, char: str) -> int:
        """0 letter, 1 number, 2 other."""
        found = self.kinds.get(char)
        if found is None:
            found = {"L": 0, "N": 1}.get(unicodedata.category(char)[0], 2)
            self.kinds[char] = found
        return found

    def split(self, text: str) -> list[str]:
        if text.isalpha():
            return [text]
        pieces, state, begin = [], self.START, 0
        kinds = self.kinds
        for i, char in enumerate(text):
            kind = kinds.get(char)
            if kind is None:
                kind = self.kind(char)
            if state == self.PENDING:  # an apostrophe and r, v or l
                if self.PAIRS[text[i - 1]] == char:
                    pieces.append(text[begin : i + 1])
                    state, begin = self.START, i + 1
                    continue
                pieces.append(text[begin : i - 1])
                state, begin = self.LETTERS, i - 1
            if state == self.MARK:
                if char in self.SINGLE:
                    pieces.append(text[begin : i + 1])
                    state, begin = self.START, i + 1
                    continue
                if char in self.PAIRS:
                    state = self.PENDING
                    continue
                state = self.OTHERS
            if state == self.LETTERS and kind == 0 or state == self.OTHERS and kind == 2:
                continue
            if state != self.START:
                pieces.append(text[begin:i])
            begin = i
            if kind == 0:
                state = self.LETTERS
            elif kind == 1:
                pieces.append(char)
                state, begin = self.START, i + 1
            else:
                state = self.MARK if char == "'" else self.OTHERS
        if state == self.PENDING:
            pieces += [text[begin:-1], text[-1]]
        elif state != self.START:
            pieces.append(text[begin:])
        return pieces


class Counter:
    """Counting transducer over bytes; symbol 256 + b is byte b at the end of a pre-token."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], suffix: str) -> None:
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.suffix = suffix
        letters = byte_letters()
        self.symbols = [*letters, *(c + suffix for c in letters)]
        number = {c: i for i, c in enumerate(letters)}
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, str] = {}
        self.grows: set[int] = set()
        nodes = 1
        for token in vocabulary:
            ended = token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if ended else token
            if any(c not in number for c in body):
                continue
            path = [number[c] for c in body]
            if ended:
                path[-1] += 256
            at = 0
            for symbol in path:
                self.grows.add(at)
                nxt = self.child.get((at, symbol))
                if nxt is None:
                    nxt = self.child[at, symbol] = nodes
                    nodes += 1
                at = nxt
            self.token[at] = token
        self.alone: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A live start: (node of what has grown, token before it, its count minus ours).
        self.states: list[tuple] = [((0, None, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def encode(self, parts: list[str]) -> list[str]:
        """Merges by rank, leftmost first; only for the short texts of one or two tokens."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def letters_of(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fits(self, before: str | None, token: str) -> bool:
        if before is None:
            found = self.alone.get(token)
            if found is None:
                found = self.alone[token] = self.encode(self.letters_of(token)) == [token]
            return found
        if not self.fits(None, token):
            return False
        found = self.pairs.get((before, token))
        if found is None:
            both = self.letters_of(before) + self.letters_of(token)
            found = self.pairs[before, token] = self.encode(both) == [before, token]
        return found

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the token count) of a transition."""
        grown, ending = [], None
        for node, before, lead in self.states[state]:
            nxt = self.child.get((node, symbol))
            if nxt is None:
                continue
            token = self.token.get(nxt)
            if token is not None and ending is None and self.fits(before, token):
                ending = (token, lead + 1)
            if nxt in self.grows:
                grown.append((nxt, before, lead))
        if ending is None:
            raise ValueError("the vocabulary does not cover all bytes")
        token, change = ending
        after = (*((node, before, lead - change) for node, before, lead in grown), (0, token, 0))
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state * 512 + symbol] = (number, change)
        return move

    def count(self, piece: str) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        data = piece.encode()
        state = total = 0
        moves = self.moves
        for byte in data[:-1]:
            move = moves.get(state * 512 + byte) or self.compile(state, byte)
            state = move[0]
            total += move[1]
        move = moves.get(state * 512 + data[-1] + 256) or self.compile(state, data[-1] + 256)
        return total + move[1]


@dataclass
class ChunkMap:
    """State map of a chunk: ``head`` is run from the state on its left, ``count`` tokens lie
    between head and ``tail``, whose state is handed on. Without a ``border`` the whole chunk
    is its head."""

    head: str
    border: bool
    count: int
    tail: str


class TokenCounter:
    """Both machines of one tokenizer file, with the counts of words seen so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.splitter = Splitter()
        self.counter = Counter(merges, model["vocab"], model["end_of_word_suffix"] or "")
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.known: dict[str, int] = {}

    def plain(self, raw: str) -> int:
        """Tokens of a raw text without white space and special tokens."""
        text = raw if raw.isascii() else unicodedata.normalize("NFC", raw).replace("Σ", "σ")
        return sum(map(self.counter.count, self.splitter.split(text.lower())))

    def word(self, raw: str) -> int:
        """Tokens of a raw text between white space."""
        found = self.known.get(raw)
        if found is None:
            parts = self.specials.split(raw)
            found = len(parts) - 1 + sum(map(self.plain, parts))
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            if len(raw) < 64:
                self.known[raw] = found
        return found

    def words(self, text: str) -> int:
        total, known = 0, self.known
        for raw in BLANKS.split(text) if SEPARATORS.search(text) else text.split():
            found = known.get(raw)
            total += self.word(raw) if found is None else found
        return total

    def map_of(self, chunk: str) -> ChunkMap:
        first = BLANKS.search(chunk)
        if first is None:
            return ChunkMap(chunk, False, 0, "")
        end = len(chunk)
        while end and chunk[end - 1] not in BLANK:
            end -= 1
        inner = self.words(chunk[first.end() : end]) if end > first.end() else 0
        return ChunkMap(chunk[: first.start()], True, inner, chunk[end:])

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        if not left.border:
            return ChunkMap(left.head + right.head, right.border, right.count, right.tail)
        if not right.border:
            return ChunkMap(left.head, True, left.count, left.tail + right.head)
        return ChunkMap(left.head, True, left.count + self.word(left.tail + right.head) + right.count, right.tail)

    def total(self, maps: list[ChunkMap]) -> int:
        """Composes neighbours in pairs until one map is left, and applies it to the start."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return sum(self.word(m.head) + m.count + self.word(m.tail) for m in maps)


def token_counter(path: str) -> TokenCounter:
    cache = worker_cache()
    if ("counter", path) not in cache:
        cache["counter", path] = TokenCounter(path)
    return cache["counter", path]


_MAP = "head string, border boolean, count bigint, tail string"


def count_tokens(docs: DataFrame, path: str, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of documents (doc_id, text)."""

    @F.pandas_udf("bigint")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = token_counter(path)
        for texts in batches:
            yield pd.Series([machine.total([machine.map_of(t or "")]) for t in texts], dtype="int64")

    @F.pandas_udf(_MAP)
    def mapped(slices: pd.Series) -> pd.DataFrame:
        machine = token_counter(path)
        return pd.DataFrame([vars(machine.map_of(s)) for s in slices], columns=["head", "border", "count", "tail"])

    @F.pandas_udf("bigint")
    def composed(lists: pd.Series) -> pd.Series:
        machine = token_counter(path)
        return pd.Series(
            [machine.total([ChunkMap(m["head"], m["border"], m["count"], m["tail"]) for m in maps]) for maps in lists],
            dtype="int64",
        )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    is_long = F.length("text") > slice_chars
    short = rows.filter(~is_long).select("doc_id", size, whole("text").alias("n_tokens"))
    # Long texts are rare: equal rows are mapped once and given out again by their number.
    long = rows.filter(is_long).groupBy("doc_id", "text").count()
    at = F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(slice_chars))).alias("slice", "begin")
    slices = long.select("doc_id", "count", F.md5("text").alias("key"), size, "text", at)
    slices = slices.select("doc_id", "count", "key", "n_bytes", "slice", F.expr(f"substring(text, begin, {slice_chars})").alias("part"))
    maps = slices.repartition("key", "slice").withColumn("map", mapped("part")).drop("part")
    inside = F.transform(F.array_sort(F.collect_list(F.struct("slice", "map"))), lambda m: m["map"])
    joined = maps.groupBy("doc_id", "count", "key", "n_bytes").agg(inside.alias("maps"))
    counted = joined.select("doc_id", "n_bytes", "count", composed("maps").alias("n_tokens"))
    again = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")))
    return short.unionByName(again.select("doc_id", "n_bytes", "n_tokens"))
