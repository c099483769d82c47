"""Bit-sliced resampling against plain sums and DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import bitsliced, queries

DOC = "doc_id bigint, text string, score string, rank string, weight string"


def brute(docs, target, buckets, width, seed, least, percent):
    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def counts(text):
        found = words(text)
        grams = [" ".join(found[i : i + n]) for n in range(1, width + 1) for i in range(len(found) - n + 1)]
        return Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(counts(text))
    for text in target:
        t.update(counts(text))
    more, fewer = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * more / ((s[b] + 1) * fewer))) for b in range(buckets)]
    rows = []
    for i, (doc_id, text) in enumerate(docs):
        own = counts(text)
        weight = sum(n * gain[b] for b, n in own.items()) // own.total() if own else 0
        key = f"{seed}:{'null' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, doc_id, len(words(text)), own.total(), weight, score))
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is None, r[1] or 0))
    ranks = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(repr((*r[1:], ranks.get(r[0]))) for r in rows)


def corpus(n=300):
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "gamma7", "déjà", "x", "名", "zeta's", "ETA-theta", "iota\x7fkappa"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 80])))) for i in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "...!"), (None, "alpha " * 30), (1003, "x " * 70_000), (1003, "x " * 70_000)]
    rows += [(7, rows[7][1])] * 40
    return rows, [" ".join(rng.choice(vocabulary[:4]) for _ in range(50)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("buckets,width,percent", [(10_000, 1, 10), (64, 3, 50), (7, 2, 100)])
def test_rows_equal_plain_sums(spark, buckets, width, percent):
    rows, target = corpus()
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOC).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, n_features int")
    found = bitsliced.resample(docs, aim, buckets, width, "9", 20, percent)
    wanted = brute(rows, target, buckets, width, "9", 20, percent)
    assert sorted(repr(tuple(r)) for r in found.collect()) == wanted


def test_sums_are_exact_for_any_counts():
    rng = np.random.default_rng(3)
    gains = rng.integers(-9000, 9000, 1000)
    counts = [rng.integers(0, 2 ** rng.integers(1, 40), 1000) for _ in range(20)] + [np.zeros(1000, dtype=np.int64)]
    sparse = [(np.flatnonzero(c), c[np.flatnonzero(c)]) for c in counts]
    planes, values = bitsliced.gain_planes(gains)
    assert bitsliced.gain_sums(sparse, planes, values, 1000) == [int(sum(int(a) * int(b) for a, b in zip(c, gains, strict=True))) for c in counts]
    assert bitsliced.gain_planes(np.zeros(9, dtype=np.int64))[1] == []


def test_pieces_keep_words_whole(monkeypatch):
    monkeypatch.setattr(bitsliced, "PIECE_BYTES", 8)
    text = "ab, déjà-vu " * 5 + "y" * 50 + "  z" * 9 + "!" * 30 + "end"
    found = [w for piece in bitsliced.word_pieces(text.encode()) for w in piece]
    assert found == re.findall(rb"[0-9a-z\x80-\xff]+", text.encode())
    whole = bitsliced.feature_buckets(text.encode(), 3, 97)
    monkeypatch.setattr(bitsliced, "PIECE_BYTES", 1 << 20)
    again = bitsliced.feature_buckets(text.encode(), 3, 97)
    assert whole[0] == again[0]
    assert Counter(np.concatenate(whole[1]).tolist()) == Counter(np.concatenate(again[1]).tolist())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    target = spark.createDataFrame([("alpha",)], "text string")
    assert bitsliced.resample(docs, target).collect() == []
    rows, _ = corpus(40)
    some = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOC)
    found = bitsliced.resample(some, target.filter("false")).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, [], 10_000, 1, "2024", 20, 10)


def test_query_equals_sql(spark, tmp_path):
    rows, target = corpus(120)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    spark.createDataFrame([(i, t, "", "", "") for i, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    found = queries.op12_bitsliced_resampling(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    con.register("benchmark", pa.table({"text": pa.array(target, pa.string())}))
    shown = con.execute(queries.RESAMPLING_SQL)
    assert found.columns == [c[0] for c in shown.description]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, shown.fetchall()))
