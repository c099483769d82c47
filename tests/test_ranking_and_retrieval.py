import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import retrieval
from tesserae.operators.ranking import chunk_rows, join_blocks, rank_in_groups, split_contiguous
from tesserae.operators.retrieval import retrieve, unit_rows


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 3, 13])
def test_rank_in_groups_with_a_hot_key(spark, partitions, n):
    partitions(n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(n)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{i % 7}", rng.randrange(40), i)
            for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    found = rank_in_groups(df, ["k"], [F.col("v").desc(), F.col("id")]).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((-v, i))
    wanted = {i: rank for group in groups.values() for rank, (_, i) in enumerate(sorted(group), 1)}
    assert len(found) == 3000
    assert {row.id: row.rk for row in found} == wanted


def test_split_and_chunk(spark):
    names = [f"s{i:03}" for i in range(23)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    split = {row.name: row.part for row in split_contiguous(df, "name", 4).collect()}
    assert split == {name: i // 6 + 1 for i, name in enumerate(names)}
    texts = spark.createDataFrame([("a", i, f"t{i}") for i in range(23)], "k string, i int, text string")
    blocks = join_blocks(chunk_rows(texts, ["k"], [F.col("i")], 10), ["k"], "text", "|")
    got = {row.block: row.text for row in blocks.collect()}
    assert got == {b: "|".join(f"t{i}" for i in range(23) if i // 10 == b) for b in range(3)}


def world(seed, images, per_image, queries, copies=False):
    rng = np.random.default_rng(seed)
    regions, asked = [], []
    for image in range(images):
        for r in range(per_image[image]):
            vector = rng.normal(size=8)
            if copies and r % 3 == 0:
                vector = np.ones(8)
            regions.append((f"im{image}", f"{r:05}", [float(np.float32(x)) for x in vector]))
    for q in range(queries):
        image = 0 if q % 3 == 0 else int(rng.integers(images))
        asked.append((q, f"im{image}", [float(np.float32(x)) for x in rng.normal(size=8)],
                      int(rng.integers(1, 9))))
    return regions, asked


def brute(regions, asked, skip=()):
    out = set()
    for q, image, vector, k in asked:
        v = np.array(vector) / np.linalg.norm(vector)
        scored = []
        for im, region, other in regions:
            if im == image and (q, region) not in skip:
                o = np.array(other) / np.linalg.norm(other)
                scored.append((-round(float(v @ o), 9), region))
        out |= {(q, region, rank) for rank, (_, region) in enumerate(sorted(scored)[:k], 1)}
    return out


def frames(spark, regions, asked):
    return (
        spark.createDataFrame(regions, "image_id string, region_id string, vector array<float>"),
        spark.createDataFrame(asked, "query_id long, image_id string, vector array<float>, k long"),
    )


@pytest.mark.parametrize("blocks", [(4096, 512), (7, 3), (1, 1)])
def test_retrieve_equals_brute_force(spark, blocks):
    regions, asked = world(1, 4, [40, 3, 9, 1], 25, copies=True)
    r, q = frames(spark, regions, asked)
    skip = {(a[0], f"{i:05}") for a in asked for i in range(0, 40, 4)}
    pairs = [(query, next(a[1] for a in asked if a[0] == query), region) for query, region in skip]
    known = {(im, region) for im, region, _ in regions}
    exclude = spark.createDataFrame(
        [p for p in pairs if (p[1], p[2]) in known], "query_id long, image_id string, region_id string"
    )
    found = retrieve(q, r, region_block=blocks[0], query_block=blocks[1])
    assert {(x.query_id, x.region_id, x.rk) for x in found.collect()} == brute(regions, asked)
    found = retrieve(q, r, exclude, region_block=blocks[0], query_block=blocks[1])
    assert {(x.query_id, x.region_id, x.rk) for x in found.collect()} == brute(regions, asked, skip)


def test_ties_go_to_the_smaller_name(spark):
    r, q = frames(spark, [("i", "b", [1.0, 0.0]), ("i", "a", [1.0, 0.0])], [(1, "i", [1.0, 0.0], 1)])
    assert [x.region_id for x in retrieve(q, r).collect()] == ["a"]


@pytest.mark.parametrize("bad", [[0.0, 0.0], [float("nan"), 1.0], [1.0]])
def test_unusable_vectors_are_refused(spark, bad):
    r, q = frames(spark, [("i", "a", bad), ("i", "b", [1.0, 0.0])], [(1, "i", [1.0, 0.0], 1)])
    with pytest.raises(Exception, match="embedding"):
        retrieve(q, r).collect()
    good, rejected = unit_rows(r, "vector", 2)
    assert [x.region_id for x in good.collect()] == ["b"]
    assert [x.region_id for x in rejected.collect()] == ["a"]


def test_few_more_than_k_rows_leave_the_blocks(spark):
    rng = random.Random(12)
    q = spark.createDataFrame(
        [(i, "im", [rng.gauss(0, 1) for _ in range(6)], 40) for i in range(5)],
        "query_id long, image_id string, vector array<float>, k long",
    ).withColumn("floor", F.lit(0).cast("bigint"))
    r = spark.createDataFrame(
        [("im", f"r{i:03}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)],
        "image_id string, region_id string, vector array<float>",
    )
    blocks = retrieval.image_blocks(q, retrieval.region_counts(r), 40, 2)
    floors = retrieval._floors(q, r, None, blocks)
    above = q.drop("floor").join(floors, "query_id")
    kept = retrieval._in_blocks(above, r, None, blocks, retrieval._score_block, retrieval._CANDIDATES)
    sizes = [row["count"] for row in kept.groupBy("query_id").count().collect()]
    assert len(sizes) == 5 and all(40 <= n <= 48 for n in sizes)


def test_picks_of_a_whole_image_are_not_ranked_again(spark, monkeypatch):
    """An image of more than 4,096 regions is still finished in one task."""
    def refuse(*_):
        raise AssertionError("picks were shuffled")

    monkeypatch.setattr(retrieval, "rank_in_groups", refuse)
    turn = (F.col("id") * 7919 % 5000) / 5000
    r = spark.range(5000).select(
        F.lit("im").alias("image_id"),
        F.lpad(F.col("id").cast("string"), 5, "0").alias("region_id"),
        F.array(F.cos(turn), F.sin(turn)).cast("array<float>").alias("vector"),
    )
    q = spark.createDataFrame([(1, "im", [1.0, 0.0], 600)], "query_id long, image_id string, vector array<float>, k long")
    found = [x.region_id for x in retrieve(q, r).orderBy("rk").collect()]
    nearest = sorted(range(5000), key=lambda i: (i * 7919 % 5000, i))[:600]
    assert found == [f"{i:05}" for i in nearest]


def test_slices_give_the_same_picks(spark, monkeypatch):
    regions, asked = world(3, 4, [40, 3, 9, 1], 25, copies=True)
    r, q = frames(spark, regions, asked)
    monkeypatch.setattr(retrieval, "CELLS", 90)
    assert {(x.query_id, x.region_id, x.rk) for x in retrieve(q, r).collect()} == brute(regions, asked)
