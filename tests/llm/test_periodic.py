"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tesserae.llm import periodic, queries

DOC = "doc_id bigint, text string, lang string, runs string, collapsed string"


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    kind, n = rng.randrange(6), rng.randrange(120)
    if kind == 0:
        return [rng.choice([b"a", b"b"]) for _ in range(n)]
    if kind == 1:
        words = []
        while len(words) < n:
            words += [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        return words
    if kind == 2:
        a, b = b"a", b"ab"
        while len(b) < n:
            a, b = b, b + a
        return [bytes([c]) for c in b[:n]]
    if kind == 3:
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 60))] * rng.randrange(1, 5)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = b"z"
        return words
    # Stretches of single words, cut and repeated: progressions that meet and overlap.
    parts = [[b"a"] * rng.randrange(1, 12) + [b"b"] for _ in range(2)]
    words = []
    for _ in range(rng.randrange(1, 9)):
        words += rng.choice([*parts, parts[0] + parts[1]]) * rng.randrange(1, 3)
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 12))]
        for words, found in zip(texts, periodic.runs_of_texts(texts), strict=True):
            runs = [] if found is None else list(zip(*(side.tolist() for side in found), strict=True))
            assert runs == brute(words)
            assert periodic.collapsed(words, found) == brute_collapsed(words, runs)


def test_meeting_progressions():
    """Runs around the border of two stretches, at several distances."""
    text = b"aabaaabaaabaaabaaabaaabaaabaaabaaabaaabaaabaabaaabaaabaaabaaabaaabaaabaa"
    words = [bytes([c]) for c in text]
    found = periodic.runs_of_texts([words])[0]
    assert list(zip(*(side.tolist() for side in found), strict=True)) == brute(words)


def test_wavelet_matrix_answers_range_successors():
    rng = np.random.default_rng(1)
    values = rng.permutation(97)
    tree = periodic.WaveletMatrix(values)
    lo = rng.integers(0, 97, 400)
    hi = np.minimum(97, lo + rng.integers(0, 60, 400))
    x = rng.integers(0, 100, 400)
    wanted = [min((v for v in values[a:b].tolist() if v >= c), default=97) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.successor(lo, hi, x).tolist() == wanted


def test_long_texts_in_one_search():
    rng = random.Random(9)
    unit = [str(rng.randrange(10**6)).encode() for _ in range(30_000)]
    texts = [unit * 3, [b"x"] * 50_000, unit[:5000] + [b"y", b"z"] * 7 + unit[:5000]]
    found = [list(zip(*(s.tolist() for s in r), strict=True)) for r in periodic.runs_of_texts(texts)]
    assert found == [[(0, 90_000, 30_000)], [(0, 50_000, 1)], [(5000, 14, 2)]]


def test_query_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 40), (4, "a " * 40), (None, "b c " * 9), (5, "é😀 " * 13)]
    rows += [(10 + i, b" ".join(random_words(rng)).decode()) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "x", "clash", "clash") for i, t in rows], DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(repr, map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect())))
    wanted = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        shown = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = [hashlib.sha256(b).hexdigest() for b in (lines.encode(), brute_collapsed(words, runs))]
        wanted.append(repr((doc_id, len(runs), *shown, *digests)))
    assert found == sorted(wanted)


def test_empty_table_and_bounds(spark):
    docs = spark.createDataFrame([], DOC)
    assert periodic.find_runs(docs).collect() == []
    with pytest.raises(ValueError):
        periodic.find_runs(docs, least=5)
