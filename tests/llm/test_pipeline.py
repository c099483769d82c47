"""The stages of the corpus pipeline, each on what the one before kept."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tesserae.llm import shared_shingles
from tests.llm.test_mixing_simhash_sharding import classes_of, water
from tests.llm.test_models import prose

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, key string, copies int"


def corpus():
    """Prose in three languages with junk, copies, near copies and awkward rows; labels for some."""
    rng = random.Random(31)
    rows, labels = [], []
    for i in range(150):
        lang = rng.choice(["aa", "bb", "cc"])
        junk = i % 5 == 0
        text = " ".join(f"%%{rng.randrange(10**6)}&" for _ in range(60)) if junk else prose(rng, lang, rng.choice([20, 60, 150]))
        rows.append((i, text, lang, rng.choice(["s1", "s2", None])))
        if i % 2 == 0:
            labels.append((i, int(not junk), 0))
    words = [t for t in rows if t[0] % 5 and len(t[1].split()) >= 60][:12]
    for n, (_, text, lang, source) in enumerate(words):
        changed = text.split()
        if n % 2:
            changed[len(changed) // 2] = "kalo"
        rows.append((1000 + n, " ".join(changed), lang, source))
    rows += [(2000, None, None, "s1"), (2001, "", "aa", None), (2002, "123 !!!", None, "s2"), (None, "kalo mitu loka", "aa", "s1")]
    rows += [(2003, prose(rng, "aa", 40), "aa", "s1")] * 3
    rows.append((2004, prose(rng, "bb", 4000), "bb", "s2"))
    return [(*r, None, "mine", "mine", 7) for r in rows], labels


def as_rows(frame):
    return Counter(map(tuple, frame.collect()))


def test_every_stage_works_on_what_is_left(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    given = as_rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        after = spark.read.schema(made.schema).parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == docs.columns
            found = as_rows(after)
            assert set(found) <= set(given)
        if name == "quality":
            kept = {r[0] for r in found}
            good = {i for i, q, _ in labels if q}
            assert len(kept & good) > 0.9 * len(good)
            assert len([i for i, q, _ in labels if not q and i in kept]) < 5
        if name == "language":
            assert all(any(c.isalpha() for c in r[1] or "") for r in found)
            assert sum(found.values()) > 0.9 * sum(n for r, n in given.items() if any(c.isalpha() for c in r[1] or ""))
        if name == "near_duplicates":
            texts = sorted({r[1] for r in given})
            near = lambda a, b: shared_shingles.jaccard(texts[a], texts[b], 5) >= 0.8
            root = classes_of(range(len(texts)), near)
            least = {}
            for r in given:
                group = root[texts.index(r[1])]
                least[group] = min(least.get(group, (True, 0)), (r[0] is None, r[0] or 0))
            assert sorted((r[0] is None, r[0] or 0) for r in found) == sorted(least.values())
            assert max(found.values()) == 1 and len(found) < len(given)
        if name == "mixing":
            sizes = Counter()
            for r, n in given.items():
                sizes[r[3]] += n * len(r[1].split())
            want = water(sizes)
            taken = Counter()
            for r, n in found.items():
                assert n <= 2 * given[r]
                taken[r[3]] += n * len(r[1].split())
            # A document is the least that can be taken more or less of.
            for source, target in want.items():
                assert abs(taken[source] - target) <= max(0.35 * target, 5000)
        if name == "packing":
            whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
            ids = {r[0]: np.array([*whole.encode(r[1], add_special_tokens=False).ids, 1], dtype="<u4") for r in given}
            due = Counter()
            for r, n in given.items():
                due[r[0]] += n * len(ids[r[0]])
            got = Counter()
            for p in after.collect():
                assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
                got[p.doc_id] += p.length
            assert got == due
        docs, given = after, as_rows(after) if name != "packing" else given
    assert as_rows(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length")) == as_rows(
        docs.select("doc_id", "start", "length"))


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_a_lower_batch_limit_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name).rstrip("b") == "1000"
        spark.conf.set(name, str(1 << 30))
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(name).rstrip("b") == str(corpus_pipeline.BATCH_BYTES)
    finally:
        spark.conf.set(name, before.rstrip("b"))
