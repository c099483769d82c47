"""Nearest neighbours, BM25 search, token counts and packing against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bm25, packing, permutation, transducer
from tesserae.llm.queries import pack_with_public_tokenizer

DOC = "doc_id bigint, text string"
WORD_FILE = str(public_tokenizers.path("word_bpe_49k.json"))
BYTE_FILE = str(public_tokenizers.path("byte_bpe_50k.json"))
HARD = [
    "",
    " \t\n ",
    "It's we'll they'RE I'd 'tis 'r 'v 'll'l don''t x'",
    "Ünï ÇODE ΣΑΣ İstanbul ﬁne é á̧",
    "漢字 カタカナ 한글 ㅏㅏ ½² Ⅷ ‍🙂👍🏽",
    "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|>",
    "tabs\x1cand\x1dseparators\x85next\xa0hard　wide",
    "1234567890 3.14 --- ... !!!??? ### @#$%^&*()",
    "supercalifragilisticexpialidocious" * 8,
    "the quick brown fox " * 200,
]


@pytest.fixture(scope="module")
def word_file():
    return Tokenizer.from_file(WORD_FILE)


def test_transducer_equals_library_on_hard_texts(word_file):
    machine = transducer.TokenCounter(WORD_FILE)
    rng = random.Random(6)
    letters = "aeinorst'xz.,!?-:0129 \n\téßΣσİ漢あ한ㅏ🙂́½Ⅷ\x85\x1c\xa0<>|"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        want = len(word_file.encode(text, add_special_tokens=False).ids)
        assert machine.total([machine.map_of(text)]) == want
        for size in (1, 3, 8):
            maps = [machine.map_of(text[i : i + size]) for i in range(0, len(text), size)]
            assert machine.total(maps or [machine.map_of("")]) == want


def test_maps_compose_in_any_grouping():
    machine = transducer.TokenCounter(WORD_FILE)
    parts = ["thi", "nking ab", "outth", "", "ings", " and more", " "]
    maps = [machine.map_of(p) for p in parts]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = machine.compose(m, right)
    assert left == right


def test_states_are_dropped_and_made_anew(monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 3)
    monkeypatch.setattr(transducer, "MOST_WORDS", 2)
    machine = transducer.TokenCounter(WORD_FILE)
    other = Tokenizer.from_file(WORD_FILE)
    for text in HARD:
        assert machine.total([machine.map_of(text)]) == len(other.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_count_tokens_cuts_long_texts(spark, word_file, size):
    rows = [*enumerate(HARD), (100, None), (8, HARD[8]), (None, "a b")]
    docs = spark.createDataFrame(rows, DOC).withColumn("count", F.lit("clash")).withColumn("key", F.lit(1))
    found = Counter(map(tuple, transducer.count_tokens(docs, WORD_FILE, size).collect()))
    want = Counter(
        (d, len((t or "").encode()), len(word_file.encode(t or "", add_special_tokens=False).ids)) for d, t in rows
    )
    assert found == want
    assert transducer.count_tokens(spark.createDataFrame([], DOC), WORD_FILE).count() == 0


def test_fast_ids_equal_those_of_tokenizers():
    whole = Tokenizer.from_file(BYTE_FILE)
    encode = packing.encoder(BYTE_FILE, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(9)
    letters = "aeinorst' .,!?-0129\n\té ßçΩ€–½²漢🙂\x85\xa0 <|>"
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["z" * 9000]
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    whole = Tokenizer.from_file(BYTE_FILE)
    rng = random.Random(1)
    rows = [(i, "word number seven " * rng.choice([0, 3, 60, 400, 2500])) for i in range(250)]
    rows += [(900, None), (901, "same text"), (901, "same text"), (None, "no id"), (902, HARD[5])]
    docs = spark.createDataFrame(rows, DOC).repartition(5).withColumn("window", F.lit("clash"))
    pieces = packing.pack_documents(docs, BYTE_FILE, with_ids=True)
    found = pieces.collect()
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in rows}
    copies = Counter(d for d, _ in rows)
    by_doc = defaultdict(list)
    for p in found:
        by_doc[p.doc_id].append(p)
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], dtype="<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes()) and list(p.ids) == part.tolist()
        assert p.doc_tokens == len(ids[p.doc_id])
    for d, mine in by_doc.items():
        starts = Counter((p.start, p.length) for p in mine)
        assert sum(p.length for p in mine) == copies[d] * len(ids[d])
        assert copies[d] > 1 or set(starts.values()) == {1}
    assert set(by_doc) == set(ids)
    by_sequence = defaultdict(list)
    for p in found:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    filled = sum(p.length for p in found)
    # The rest of most texts fits no window beside its like: only cuts keep the padding low.
    assert filled / (len(by_sequence) * packing.WINDOW) > 0.85
    whole_rows = packing.sequences(pieces).collect()
    assert len(whole_rows) == len(by_sequence)
    assert all(len(r.ids) == packing.WINDOW or len(r.ids) == r.n_ids and r.n_ids.bit_count() == 1 for r in whole_rows)
    assert pack_with_public_tokenizer(spark.createDataFrame([], DOC)).count() == 0


def test_fullest_window_leaves_when_none_fits():
    windows = packing.Windows(limit=2, size=10)
    assert windows.add("a", 6) == [] and windows.add("b", 8) == []
    assert windows.add("c", 2) == [[1, [("b", 0), ("c", 8)], 10]]
    assert windows.add("d", 7) == []
    # "a" and "d" are open, neither has room for 5; the fuller one lacks 3.
    assert windows.gap(5) == 3 and windows.gap(4) == 0 and windows.gap(10) == 0
    assert windows.add("f", 10) == [[3, [("f", 0)], 10]]
    out = windows.add("e", 5)
    assert [w[1] for w in out] == [[("d", 0)]]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)) * rng.choice([0.5, 1, 2], size=(400, 1))
    vectors[200:260] = vectors[199]
    rows = [(int(i), [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(vectors)]
    odd = [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] * 8), (580, [float("inf")] * 8), (600, []), (None, rows[0][1]), (620, [1.0, 2.0]), (621, [2.0, 1.0]), (3, rows[3][1])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    whole = permutation.nearest(table, F.col("vec_id") % 20 == 0, k=5, n_pivots=16, block_rows=64, query_rows=8).collect()
    own = [(i, np.array(v, dtype=float)) for i, v in rows + [odd[-1]]]
    found = defaultdict(list)
    for r in sorted(whole, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    for q, v in rows:
        if q % 20:
            continue
        score = sorted((-float((np.array(v) * x).sum()), i) for i, x in own if i != q)[:5]
        assert [i for i, _ in found[q]] == [i for _, i in score]
        assert [s for _, s in found[q]] == pytest.approx([-s for s, _ in score])
    assert found[620] == [(621, 4.0)]
    assert set(found) == {q for q, _ in rows if q % 20 == 0} | {620}
    assert permutation.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_footrule_by_hand():
    rng = np.random.default_rng(3)
    vectors, pivots = rng.normal(size=(2000, 16)), rng.normal(size=(32, 16))
    places = permutation.places_of(vectors, pivots)
    order = np.argsort(places[7])[:8]
    for posted in (8, 32):
        files = permutation.InvertedFiles(places, posted)
        clipped = np.minimum(places[:, order], posted)
        assert (files.footrule(order) == np.abs(clipped - np.arange(8)).sum(axis=1)).all()


def test_recall_on_directions_without_structure():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(12_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    pivots = vectors[rng.permutation(len(vectors))[: permutation.PIVOTS]]
    files = permutation.InvertedFiles(permutation.places_of(vectors, pivots), permutation.PIVOTS)
    n = max(permutation.LEAST_CANDIDATES, int(permutation.CANDIDATE_SHARE * len(vectors)))
    found = []
    for query in range(0, 1000, 20):
        order = np.argsort(permutation.places_of(vectors[[query]], pivots)[0])
        near = np.argpartition(files.footrule(order), n)[:n]
        best = np.argsort(-(vectors @ vectors[query]))[1:21]
        found.append(np.isin(best, near).mean())
    assert np.mean(found) >= 0.95


def plain_bm25(docs, query, k):
    texts = {d: (t or "").encode().lower().split() for d, t in docs}
    mean = sum(map(len, texts.values())) / len(texts)
    df = Counter(t for w in texts.values() for t in set(w))
    asked = Counter((query or "").encode().lower().split())
    found = []
    for d, words in texts.items():
        tf, units = Counter(words), 0
        for t, n in asked.items():
            if tf[t]:
                idf = math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5))
                norm = bm25.K1 * (1 - bm25.B + bm25.B * len(words) / mean)
                units += round(n * idf * tf[t] * (bm25.K1 + 1) / (tf[t] + norm) / bm25.UNIT)
        if units:
            found.append((-units, d))
    return sorted(found)[:k]


def test_search_equals_plain_bm25(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 32)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(vocabulary[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))

    docs = [(i, text(rng.choice([1, 10, 50]))) for i in range(300)] + [(300, None), (301, ""), (302, "W1 w1")]
    asked = [(1, "w1 w50 W50 nowhere"), (2, text(30)), (3, None), (4, "nowhere"), (5, "w59 w58")]
    table = spark.createDataFrame(docs, DOC).repartition(3).withColumn("term", F.lit("clash"))
    queries = spark.createDataFrame(asked, "query_id bigint, text string").withColumn("weight", F.lit("clash"))
    index = bm25.build_index(table)
    found = defaultdict(list)
    for r in bm25.search(queries, index, k=7, queries_at_once=2).orderBy("query_id", "rank").collect():
        found[r.query_id].append((-round(r.score / bm25.UNIT), r.doc_id))
    for q, t in asked:
        assert found[q] == plain_bm25(docs, t, 7)
    assert bm25.search(queries, bm25.build_index(table.limit(0))).count() == 0
    assert bm25.search(queries.limit(0), index).count() == 0


def test_blocks_are_pruned():
    lengths = np.full(bm25.BLOCK * 64, 10)
    docs = np.arange(len(lengths))
    counts = np.where(docs < 20, 9, 1)
    blocks = np.arange(64)
    most = np.where(blocks == 0, 9, 1)
    found, units, opened = bm25.best_in_shard([(1.0, docs, counts, blocks, most, np.full(64, 10))], lengths, 10.0, 5)
    assert opened == bm25.FIRST_BLOCKS and set(found) == set(range(20))


def test_every_twentieth_document_is_asked(spark):
    from tesserae.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id for r in docs.filter("doc_id % 20 = 0 and text rlike '[^ \\\\t-\\\\r]'").collect()}
    found = QUERIES["op4_document_search"](spark, sf_dir).collect()
    assert want and {r.query_id for r in found} == want
