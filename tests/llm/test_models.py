"""Importance resampling, language identification and backoff scores."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tesserae.llm import backoff, importance, langid
from tesserae.llm.common import crc_bucket
from tesserae.runtime import shared_dir

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "en", "ver", "ung"], "cc": ["eau", "oi", "tion", "é"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(spark, n=240, extra=()):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.choice([1, 5, 80])), lang, "s", None))
    return spark.createDataFrame([*rows, *extra], DOC)


ODD = [
    (1000, None, None, None, None),
    (1001, "", "aa", "s", 0),
    (1002, "123 !!! ½² \n", None, "s", 0),
    (1005, "½x²", None, "s", 0),
    (1003, "kalo mitu", None, "s", 0),
    (1003, "kalo mitu", None, "s", 0),
    (None, "verung enschen", None, "s", 0),
    (1004, "x" * 5000, None, "s", 0),
]


def test_languages_are_told_apart_and_oddities_defined(spark):
    docs = corpus(spark, extra=ODD).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    train = docs.filter("lang is not null and text is not null").filter(crc_bucket(F.col("doc_id"), 4) != 2)
    models = langid.train(train.select(F.col("doc_id").alias("key"), "lang", "text"))
    found = langid.identify(docs, models)
    assert found.columns == [*docs.columns, "__lang"]
    rows = found.collect()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [r["__lang"].lang_pred == r.lang for r in held]
    assert len(held) > 30 and sum(right) / len(right) > 0.97
    assert all(0 <= r["__lang"].score <= 1 for r in rows)
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r["__lang"].lang_pred == "und") == (not letters)
        assert r["__lang"].rejected or letters
    twins = [r["__lang"] for r in rows if r.doc_id == 1003]
    assert twins[0] == twins[1] and twins[0].lang_pred == "aa"
    far = next(r["__lang"] for r in rows if r.doc_id == 1004)
    assert far.rejected
    clean = [r["__lang"].rejected for r in rows if r.doc_id is not None and r.doc_id < 1000]
    assert not any(clean)


def test_kneser_ney_probabilities_add_up(spark):
    docs = corpus(spark, 60)
    models = langid.train(docs.select(F.col("doc_id").alias("key"), "lang", "text"))
    letters = sorted({c for row in docs.select("text").collect() for c in row.text if c != " "})
    # After the border and "ka": every letter, and the end of the word.
    total = np.zeros(len(models.languages))
    for stem in ("", "ka", "sch"):
        known = models.word_costs([stem])[0][0] if stem else 0
        sums = np.zeros(len(models.languages))
        for letter in letters:
            cost = models.word_costs([stem + letter])[0][0] - _end_cost(models, stem + letter)
            base = known - _end_cost(models, stem) if stem else 0
            sums += np.exp(-(cost - base))
        if stem:
            sums += np.exp(-_end_cost(models, stem))
        total = np.maximum(total, sums)
        assert (sums <= 1 + 1e-9).all() and (sums > 0.9).all()


def _end_cost(models, word):
    """Cost of the border after a word: costs of the word as a whole less those of its letters."""
    codes, reach = langid.symbols_of([word])
    whole = models.word_costs([word])[0][0]
    letters = _letters_cost(models, word)
    return whole - letters


def _letters_cost(models, word):
    keys = langid.gram_keys(langid.symbols_of([word])[0])
    total = np.zeros(len(models.languages))
    for i in range(1, len(word) + 1):
        p = np.full(len(models.languages), models.uniform)
        for n in range(1, min(langid.ORDER, i + 1) + 1):
            weight = models.root_gamma if n == 1 else _row(models.keys[n - 2], models.gamma[n - 2], keys[n - 1][i - 1], 1.0)
            p = _row(models.keys[n - 1], models.alpha[n - 1], keys[n][i], 0.0) + weight * p
        total -= np.log(p)
    return total


def _row(keys, table, key, default):
    at = int(np.searchsorted(keys, key))
    return table[at] if at < len(keys) and keys[at] == key else default


def test_without_training_rows_everything_is_unknown(spark):
    empty = corpus(spark, 0).select(F.col("doc_id").alias("key"), "lang", "text")
    assert langid.train(empty) is None
    assert langid.identify(corpus(spark, 2), None).filter("__lang.lang_pred = 'und'").count() == 2


@pytest.mark.parametrize("block_bytes", [1 << 23, 500])
def test_base_scores_and_counts_equal_plain_ones(spark, block_bytes):
    docs = corpus(spark, 120, ODD)
    held_out = crc_bucket(F.col("doc_id"), 7) == 2
    rows = docs.select("doc_id", "text").collect()

    def held(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2

    counts = Counter()
    for doc, text in rows:
        if not held(doc):
            counts.update((text or "").encode().lower().split())
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    found = backoff.score_documents(docs, held_out, block_bytes).collect()
    assert len(found) == len(rows)
    want = Counter()
    for doc, text in rows:
        tokens = [*(text or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want[doc, held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found)
    assert got == want
    assert {r.train_tokens for r in found} == {n}
    assert all(r.score < 0 for r in found)
    tested = [r for r in found if r.held_out]
    # All words are known here, which is the best case of the base.
    assert sum(r.score for r in tested) > 1.01 * sum(r.base_score for r in tested)


def test_every_word_is_a_state(spark):
    """More words than any bound on states; a plain model of all pairs gives the same scores."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.25)) % 3000}" for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts, pairs = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            counts.update([*text.split(), "end"])
            pairs.update(zip(["start", *text.split()], [*text.split(), "end"], strict=True))
    n, ends = sum(counts.values()), counts["end"]
    assert len(counts) > 700
    several = Counter(c for w, c in counts.items() if w != "end")
    off = min(0.9, max(0.1, several[1] / (several[1] + 2 * several[2])))
    kinds = Counter(u for u, _ in pairs)

    def root(w):
        return (counts[w] - off) / n if counts[w] else off * len(counts) / n

    def after(u, w):
        c = ends if u == "start" else counts[u]
        if not c:
            return root(w)
        alpha = max(pairs[u, w] - backoff.DISCOUNT, 0) / (c + backoff.STRENGTH)
        return alpha + (1 - (c - backoff.DISCOUNT * kinds[u]) / (c + backoff.STRENGTH)) * root(w)

    found = backoff.score_documents(docs, crc_bucket(F.col("doc_id"), 7) == 2, 1500)
    got = {r.doc_id: r.score for r in found.collect()}
    for i, text in rows:
        path = ["start", *text.split(), "end"]
        assert got[i] == pytest.approx(sum(math.log10(after(u, w)) for u, w in zip(path, path[1:])))


def on_disk(spark):
    """Shuffle files and written tables of the session, with their sizes."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    found = {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size())}
    shared = Path(shared_dir(spark).removeprefix("file:"))
    return found | {str(f): f.stat().st_size for f in shared.rglob("*") if f.is_file()}


def test_counts_take_less_disk_than_twice_the_texts(spark):
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (20_000, 6))])
    rows = [(i, " ".join(rng.choice(words, 2000))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = on_disk(spark)
    assert len(backoff.score_documents(docs, F.col("doc_id") % 7 == 2).collect()) == 200
    taken = sum(size for path, size in on_disk(spark).items() if path not in before)
    assert 0 < taken < 2 * sum(len(text) for _, text in rows)


def by_shard(tables, tally):
    """The answers of all shards."""
    rows = pa.concat_tables([t for t in tables if t.num_rows])
    shards = rows.column("shard").unique().to_pylist()
    return pa.concat_tables([tally(rows.filter(pc.equal(rows.column("shard"), s))) for s in shards])


def scored(blocks, shards):
    """Scores of blocks of (doc_id, held out, text), the steps of the job one after the other."""
    rows = []
    for i, docs in enumerate(blocks):
        made = backoff._Block()
        for doc in docs:
            made.add(*doc)
        rows.append(made.row(i, shards))
    asked = [pa.table({"block": [r["block"]] * len(r["asked"]), **pa.Table.from_pylist(r["asked"]).to_pydict()}) for r in rows]
    words = by_shard(asked, backoff.tally_words).to_pylist()
    most, ends = 1 + shards * max(w["distinct"] for w in words), sum(not held for docs in blocks for _, held, _ in docs)
    rows = [r | {"known": [w for w in words if w["block"] == r["block"]], "answers": []} for r in rows]
    batches = [pa.RecordBatch.from_pylist([r]) for r in rows]
    pairs = pa.Table.from_batches(backoff.ask_pairs(shards, most, ends)(batches))
    answers = by_shard([pairs], backoff.tally_pairs(most)).to_pylist()
    rows = [r | {"answers": [a for a in answers if a["block"] == r["block"]]} for r in rows]
    batches = [pa.RecordBatch.from_pylist([r]) for r in rows]
    tokens, kinds = ends + sum(w["tokens"] for w in words), 1 + sum(w["kinds"] for w in words)
    found = backoff.score_blocks(shards, most, ends, tokens, kinds, 0.5)(batches)
    return pairs.num_rows, pa.Table.from_batches(found).to_pylist()


def test_frequent_states_in_several_shards_and_long_blocks_in_runs_score_alike(monkeypatch):
    rng = random.Random(2)
    docs = [(i, i % 7 == 2, " ".join(f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randint(0, 60)))) for i in range(60)]
    blocks = [docs[:25], docs[25:26], docs[26:]]
    parts, want = scored(blocks, 3)
    assert parts <= 9 and all(r["score"] < 0 for r in want)
    assert scored(blocks, 40)[1] == want
    # Frequent states in 3 or 40 shards, a few tokens at a time.
    monkeypatch.setattr(backoff, "STATE_TOKENS", 4)
    monkeypatch.setattr(backoff, "TOKENS_AT_ONCE", 7)
    assert scored(blocks, 3)[1] == want
    assert scored(blocks, 40)[1] == want


def test_numbers_are_packed_whole():
    for numbers in ([], [0], [5, 5, 6, 1 << 62], list(range(1000))):
        assert backoff.unpack(backoff.pack(np.array(numbers, dtype=np.int64))).tolist() == numbers
        assert backoff.unpack_ascending(backoff.pack_ascending(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_automaton_adds_up_to_one():
    rng = np.random.default_rng(0)
    k = 4
    pairs = rng.integers(0, 9, (k + 1, k + 1))
    context = pairs.sum(axis=1) + rng.integers(1, 5, k + 1)
    machine = backoff.Automaton([b"a", b"b", b"c", b"d"], context, pairs)
    # Four frequent words, the end, and a rest of two more words and the unknown one.
    root = np.array([0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])
    states = np.array([0, 1, 2, 3, k, k + 1, k + 1, k + 1])
    for start in range(k + 2):
        logs = [machine.log_probabilities(np.array([s]), start, np.log10(root[i : i + 1]))[0] for i, s in enumerate(states)]
        assert sum(10.0**x for x in logs) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = corpus(spark, 5)
    found = backoff.score_documents(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.score == 0 and r.n_known == 0 for r in found)
    assert backoff.score_documents(corpus(spark, 0), F.lit(False)).count() == 0


def test_importance_drops_what_is_unlike_the_target(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = prose(rng, "aa", 60)
        rows.append((i, " ".join(w + "***" for w in text.split()) if bad else text, None, "s", None))
        if i % 2:
            labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, *ODD], DOC).withColumn("key", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = importance.resample(docs, marks).collect()
    assert len(found) == len(rows) + len(ODD)
    clean = [r.selected for r in found if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 5]
    junk = [r.selected for r in found if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 5 == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.05
    assert all(r.log_weight == 0 for r in found if r.doc_id in (1000, 1001))
    # The k largest keys, and only those.
    inside = [r.key for r in found if r.selected]
    assert min(inside) >= max(r.key for r in found if not r.selected)
    kept = importance.select_documents(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(str(r.doc_id) for r in found if r.selected)


def test_importance_without_labels_keeps_everything(spark):
    docs = corpus(spark, 10, ODD)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, quality int")
    assert importance.resample(docs, none).filter("selected").count() == docs.count()
    assert importance.resample(corpus(spark, 0), none).count() == 0


def test_parting_by_hand():
    scores, good = np.array([-5.0, -4, -1, 0, 2]), np.array([False, False, True, True, True])
    assert importance.parting(scores, good) == -2.5
    assert importance.parting(scores, np.ones(5, dtype=bool)) == 0


def test_scoring_holds_little_beside_its_models():
    import tracemalloc

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(600)]
    counts = pd.concat(langid.count_grams([pd.DataFrame({"lang": "en", "text": texts[:30]})]))
    models = langid.fit(counts)
    tracemalloc.start()
    langid.Scorer(models).entropies(texts)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for rows in langid.count_grams([pd.DataFrame({"lang": "en", "text": texts})]):
        del rows
    counted = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored < 24e6 and counted < 48e6
