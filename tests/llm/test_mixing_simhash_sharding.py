"""Mixing, SimHash links and shards against brute force on small inputs."""

import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tesserae.llm import mixing, sharding, shared_shingles, simhash
from tesserae.llm.common import written
from tesserae.llm.graph import components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_fingerprint(text, width=3):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(values, near):
    """Least member reachable, by plain search."""
    root = {}
    for start in sorted(values):
        if start in root:
            continue
        stack = [start]
        root[start] = start
        while stack:
            at = stack.pop()
            for other in values:
                if other not in root and near(at, other):
                    root[other] = start
                    stack.append(other)
    return root


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOC)


AWKWARD = [
    (1, None, None),
    (2, "", "a"),
    (3, " \t\n", "a"),
    (4, "one", "b"),
    (4, "one", "b"),
    (None, "one two", "b"),
    (6, "Ünï Çode ÉCOLE  x", "ß"),
    (7, "word " * 3000, "b"),
    (8, "one two three four", None),
    (9, "one two three four", "a"),
]


def test_fingerprints_by_hand(spark):
    found = documents(spark, AWKWARD).select("text", simhash.fingerprints(F.col("text")).alias("fp")).collect()
    for text, value in found:
        assert value % (1 << 64) == plain_fingerprint(text)


def test_long_text_is_read_in_runs(monkeypatch):
    from tesserae.llm import common

    text = " ".join(f"w{i % 97}x" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(common, "RUN_BYTES", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("limit", [2048, 4])
@pytest.mark.parametrize("bits", [2, 3])
def test_links_equal_brute_force(spark, limit, bits):
    rng = random.Random(5 + bits)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(14):
            value = base
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = written(spark.createDataFrame([(0, v) for v in signed], "view int, fp bigint"), "test")
    roots = components(simhash.links(fps, bits, limit))
    found = defaultdict(set)
    for node, root in roots.collect():
        found[root].add(node)
    want = defaultdict(set)
    for node, root in classes_of(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= bits).items():
        want[root].add(node)
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_near_duplicates_of_awkward_rows(spark):
    rows = simhash.near_duplicates(documents(spark, AWKWARD)).collect()
    fps = {f for _, f, _ in rows}
    want = classes_of(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = {}
    for doc, fp, _ in rows:
        if doc is not None:
            least[want[fp]] = min(doc, least.get(want[fp], doc))
    assert len(rows) == len(AWKWARD)
    assert all(component == least.get(want[fp]) for _, fp, component in rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_pipeline_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    rows, near = [], []
    for base in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 60, 200]))]
        rows.append((base * 10, " ".join(words), "s"))
        if base % 3 == 0:
            rows.append((base * 10 + 1, " ".join(words), "s"))
        if base % 3 == 1 and len(words) > 50:
            changed = list(words)
            changed[len(words) // 2] = "changed"
            rows.append((base * 10 + 2, " ".join(changed), "t"))
            near.append(base * 10 + 2)
    rows += [(1000, None, "n"), (1001, "", "n"), (1002, "same", "n"), (1002, "same", "n"), (None, "same", "n")]
    docs = documents(spark, rows).withColumn("node", F.lit("mine")).withColumn("view", F.lit(1))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    want = [i for i, _, _ in rows if i is not None and i < 1000 and i % 10 != 1 and i not in near]
    assert [i for i in ids if i < 1000 and i not in near] == sorted(want)
    assert [i for i in ids if i >= 1000] == [1000, 1002]
    assert len([i for i in near if i in ids]) <= len(near) // 4
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def kept_ids(spark, texts, **options):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    return sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, **options).collect())


def kept_by_brute_force(texts):
    root = classes_of(range(len(texts)), lambda a, b: shared_shingles.jaccard(texts[a], texts[b], 5) >= 0.8)
    return sorted(set(root.values()))


def edited(rng, words, edits):
    changed = list(words)
    for place in rng.sample(range(len(words)), edits):
        changed[place] = f"e{rng.randrange(10**6)}"
    return " ".join(changed)


def test_hub_that_is_similar_to_nobody_hides_no_link(spark):
    # Every text has the line many times; hubs are close to all by fingerprint and below 0.8.
    rng = random.Random(17)
    line = "the line that is repeated in every text of this bucket "
    texts = []
    for _ in range(8):
        tail = [f"t{rng.randrange(10**6)}" for _ in range(40)]
        texts += [line * 60 + " ".join(tail), line * 60 + " ".join([*tail[:-1], "other"])]
    assert len(kept_by_brute_force(texts)) == 8
    assert kept_ids(spark, texts) == kept_by_brute_force(texts)


def test_no_one_word_edit_of_enough_similarity_stays(spark):
    rng = random.Random(23)
    texts = []
    for n in [49, 50, 60, 80, 120, 200] * 20:
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts += [" ".join(words), edited(rng, words, 1)]
    assert all(shared_shingles.jaccard(a, b, 5) >= 0.8 for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert kept_ids(spark, texts) == list(range(0, len(texts), 2))


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(29)
    texts = []
    for n in (60, 100):
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts += [edited(rng, words, rng.choice([0, 1, 1, 2, 3])) for _ in range(40)]
    want = kept_by_brute_force(texts)
    assert 2 < len(want) < 60
    assert kept_ids(spark, texts, bucket_limit=4) == want
    assert kept_ids(spark, texts, bucket_limit=2048) == want


def test_texts_around_the_limit_are_all_compared(spark):
    """Many candidates that are no links, so that groups hand on more in several rounds."""
    rng = random.Random(37)
    words = [f"w{rng.randrange(4000)}" for _ in range(120)]
    texts = [edited(rng, words, rng.choice([1, 2, 2, 3, 3])) for _ in range(60)]
    near = [shared_shingles.jaccard(a, b, 5) for i, a in enumerate(texts) for b in texts[:i]]
    assert sum(0.7 < s < 0.8 for s in near) > 300
    assert kept_ids(spark, texts) == kept_by_brute_force(texts)
    apart = []
    for i in range(30):
        changed = list(words)
        changed[7 * (i % 15) : 7 * (i % 15) + 2] = [f"x{i}", f"y{i}"]
        apart.append(" ".join(changed + [f"tail{i}{j}" for j in range(10)]))
    assert kept_ids(spark, apart) == kept_by_brute_force(apart)


def test_a_pair_is_handed_on_by_one_group_only(spark, monkeypatch):
    """Texts share up to 20 shingles of their prefixes, so most pairs meet in many groups."""
    rng = random.Random(41)
    words = [f"w{rng.randrange(4000)}" for _ in range(100)]
    texts = [edited(rng, words, rng.choice([1, 2, 3])) for _ in range(60)]
    handed = []
    real = shared_shingles._candidates

    def counted(*arguments):
        found = real(*arguments)
        handed.extend([tuple(r) for r in found.filter("a IS NOT NULL").select("a", "b").collect()] + [None])
        return found

    monkeypatch.setattr(shared_shingles, "_candidates", counted)
    assert kept_ids(spark, texts, bucket_limit=16) == kept_by_brute_force(texts)
    first = handed[: handed.index(None)]
    assert len(first) > 40
    assert len(first) == len(set(first))


def test_stage_verifies_what_simhash_links(spark, monkeypatch):
    """The stage runs SimHash on all texts: its links are the first that are verified, and those of texts
    that are not similar join nothing."""
    rng = random.Random(43)
    line = "the line that is repeated in every text of this bucket "
    texts = [line * 60 + " ".join(f"t{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    for n in (400, 500, 600) * 4:
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts += [" ".join(words), edited(rng, words, 1)]
    texts += [None, "", "a b", "A  b"]
    handed = []
    real = shared_shingles._verified

    def kept(pairs, *arguments):
        handed.append([tuple(r) for r in pairs.select("a", "b").collect()])
        return real(pairs, *arguments)

    monkeypatch.setattr(shared_shingles, "_verified", kept)
    assert kept_ids(spark, texts) == kept_by_brute_force(texts)
    nodes = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).select(F.xxhash64(F.coalesce("text", F.lit(""))))
    node = [r[0] for r in nodes.collect()]
    root = classes_of(
        range(len(texts)),
        lambda a, b: (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() <= simhash.MAX_BITS,
    )
    want = {frozenset(node[i] for i in root if root[i] == r) for r in root.values()}
    linked = classes_of({n for pair in handed[0] for n in pair}, lambda a, b: (min(a, b), max(a, b)) in handed[0])
    found = {frozenset(n for n in linked if linked[n] == r) for r in linked.values()}
    assert found == {w for w in want if len(w) > 1}
    assert len(found) > 5


def water(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Targets by repeated resharing of what goes beyond the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 7, 50, 900]) for s in ["a", "b", "É", "zz", "c", None]}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    plan = mixing.mix_plan(documents(spark, rows)).collect()
    want = water(sizes)
    for row in plan:
        source = rows[row.doc_id][2]
        assert row.source_size == sizes[source]
        assert row.target == pytest.approx(want[source])
        assert row.taken <= 2 * row.size


def test_mix_keeps_columns_and_agrees_with_plan(spark):
    docs = documents(spark, AWKWARD).withColumn("rate", F.lit("mine")).withColumn("target", F.lit(1))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    again = mixing.mix(docs).groupBy("doc_id").count().collect()
    counts = dict(mixed.groupBy("doc_id").count().collect())
    assert counts == dict(again)
    due = defaultdict(int)
    for row in mixing.mix_plan(docs).collect():
        due[row.doc_id] += row.copies
    assert counts == {k: v for k, v in due.items() if v}
    assert mixing.mix(documents(spark, [])).count() == 0


def shards_of(rows, limit):
    """Split oversized prefixes one bit at a time."""
    import hashlib

    def key(doc):
        return bin(int(hashlib.md5(("null" if doc is None else str(doc)).encode()).hexdigest()[:15], 16))[2:].zfill(60)

    found, todo = {}, [("", [(key(d), n) for d, n in rows])]
    while todo:
        prefix, inside = todo.pop()
        if sum(n for _, n in inside) <= limit or len(inside) <= 1 or len(prefix) == 60:
            for k, _ in inside:
                found[k] = prefix
            continue
        for bit in "01":
            todo.append((prefix + bit, [x for x in inside if x[0][len(prefix)] == bit]))
    return {d: found[key(d)] for d, _ in rows}


def test_shards_split_only_what_is_too_large(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.choice([1, 40, 300, 3000]), "s") for i in range(200)] + [(None, "y" * 10, "s"), (500, None, None)]
    limit = 2000
    found = sharding.assign_shards(documents(spark, rows), limit).collect()
    want = shards_of([(d, len(t or "")) for d, t, _ in rows], limit)
    assert {r.doc_id: r.shard for r in found} == want
    assert all(r.page == 0 and r.depth == len(r.shard) for r in found)


def test_repeated_ids_are_paged(spark, tmp_path):
    rows = [(7, "z" * 100, "s")] * 50 + [(i, "q" * 100, "s") for i in range(20)]
    docs = documents(spark, rows).withColumn("shard", F.lit("clash"))
    assigned = sharding.assign_shards(docs, 1000)
    report = sharding.shard_report(assigned, 1000).collect()
    assert sum(r["rows"] for r in report) == 70
    assert not any(r.oversize for r in report)
    sharding.write_shards(docs, str(tmp_path / "shards"), 1000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 70
    assert sharding.assign_shards(documents(spark, []), 10).count() == 0
