"""Keyed stores, observation caches, assembled parts and shard manifests."""

import os

import pytest
from pyspark.sql import functions as F

from tesserae.operators.cache import ObservationCache
from tesserae.operators.sets import assemble, assembled
from tesserae.runtime import scratch_path
from tesserae.sources import manifest
from tesserae.streaming.store import KeyedStore

ROWS = "k string, n int, payload string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def local(path):
    return path.removeprefix("file:")


def test_store_keeps_the_newest_row_and_merges_versions(spark):
    store = KeyedStore(spark, scratch_path(spark, "store"), ["k"], "n", buckets=4, keep_versions=2)
    wanted = {}
    for version in range(9):
        batch = [(f"k{i}", i + version % 3, f"v{version}") for i in range(version, 12, 2)]
        # A batch that is written twice replaces itself.
        for _ in range(1 + version % 2):
            store.upsert(rows(spark, *batch), version)
        wanted |= {k: p for k, _, p in batch}
        assert {r.k: r.payload for r in store.current().collect()} == wanted
        assert all(len(store.versions(b)) <= 2 for b in range(4))
    store.upsert(spark.createDataFrame([], ROWS), 99)
    assert store.current().count() == len(wanted)
    grown = store.rebucket(scratch_path(spark, "store"), 16)
    assert {r.k: r.payload for r in grown.current().collect()} == wanted
    order = KeyedStore(spark, scratch_path(spark, "store"), ["k"], "n", buckets=2, late_wins=False)
    order.upsert(rows(spark, ("a", 5, "high")), 0)
    order.upsert(rows(spark, ("a", 1, "late")), 1)
    assert order.current().first().payload == "high"


def test_a_batch_reads_only_its_buckets(spark):
    """The same batch on a small table and on one forty times as large, with buckets in proportion."""
    read = {}
    for size, buckets in ((200, 16), (8000, 640)):
        store = KeyedStore(spark, scratch_path(spark, "store"), ["k"], "n", buckets=buckets)
        for version in (0, 1):
            whole = spark.range(size).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(version).alias("n"), F.lit("p").alias("payload"))
            store.upsert(whole, version)
        batch = rows(spark, ("k3", 7, "p"), ("k77", 7, "p"))
        touched = store.touched(batch.withColumn("bucket", store.bucket_of()))
        files = store.read(touched).inputFiles()
        assert len(touched) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in files} == set(touched)
        read[size] = sum(os.path.getsize(local(f)) for f in files)
        store.upsert(batch, 2, receipt="payload")
        with pytest.raises(ValueError, match="changed receipt"):
            store.upsert(rows(spark, ("k3", 8, "other")), 3, receipt="payload")
        with pytest.raises(ValueError, match="changed receipt"):
            store.upsert(rows(spark, ("new", 1, "x"), ("new", 2, "y")), 3, receipt="payload")
        # The batch itself may come again.
        store.upsert(batch, 2, receipt="payload")
        assert store.current().count() == size
    assert read[8000] < 2 * read[200]


def test_tampered_observations_are_made_again(spark):
    cache = ObservationCache(spark, scratch_path(spark, "observations"))
    images = spark.createDataFrame([("a", "p/a", "1"), ("b", "p/b", "2"), ("none", "p/n", "3")], "image_id string, path string, image_sha256 string")
    made = []

    def compute(missing):
        made.append(sorted(r.image_id for r in missing.collect()))
        some = missing.filter("image_id <> 'none'")
        return some.select("cache_key", F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("region_id"), F.col("image_id").alias("value"))

    def states(frame=images):
        return {r.image_id: r.state for r in cache.observe(frame, ["path", "image_sha256"], compute).collect()}

    assert set(states().values()) == {"computed"} and made == [["a", "b", "none"]]
    assert set(states().values()) == {"hit"} and len(made) == 1
    inventory = {r.image_id: r for r in cache.inventory().collect()}
    assert (inventory["a"].path, inventory["a"].regions, inventory["a"].value_bytes) == ("p/a", 2, 2)
    assert (inventory["none"].regions, inventory["none"].content_sha256) == (0, None)
    # One region of b goes missing; the rest of the batch stays as it was.
    place, other = f"{cache.root}/entries/batch=1", scratch_path(spark, "other")
    spark.read.parquet(place).filter("value <> 'b' OR region_id <> 'r1'").write.parquet(other)
    spark.read.parquet(other).write.mode("overwrite").parquet(place)
    assert states() == {"a": "hit", "b": "recomputed", "none": "hit"} and made[-1] == ["b"]
    assert states() == {"a": "hit", "b": "hit", "none": "hit"}
    assert cache.entries().count() == 4
    # Another image file is another key.
    changed = images.withColumn("image_sha256", F.lit("9"))
    assert set(states(changed).values()) == {"computed"}


def test_assembly_names_the_origins_of_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "id string, v int")
    b = spark.createDataFrame([("x", "w"), ("z", "w"), ("z", "w"), (None, "w")], "id string, w string")
    found = {(r.id, r.origin): (r.v, r.w, r.conflict) for r in assemble({"a": a, "b": b}, ["id"]).collect()}
    assert found == {
        ("x", "a"): (1, None, ["a", "b"]), ("x", "b"): (None, "w", ["a", "b"]), ("y", "a"): (2, None, None),
        ("z", "b"): (None, "w", ["b x 2"]), (None, "a"): (3, None, ["a", "b"]), (None, "b"): (None, "w", ["a", "b"])}
    with pytest.raises(ValueError, match="repeated key"):
        assembled({"a": a, "b": b}, ["id"])
    assert assembled({"a": a.filter("id = 'y'"), "b": b.filter("id = 'x'")}, ["id"]).count() == 2


def test_shards_belong_to_their_parent(spark):
    parent, path = scratch_path(spark, "manifest"), scratch_path(spark, "shards")
    whole = spark.range(40).select(F.concat(F.lit("s"), "id").alias("sample_id"), F.col("id").alias("v"))
    manifest.write_manifest(whole, parent)
    digest = spark.read.json(f"{parent}/header").first().digest
    sharded = whole.withColumn("shard", F.col("v") % 3)
    headers = manifest.write_shard_manifests(sharded, path, parent)
    assert {(r.shard, r.rows, r.shard_count) for r in headers.collect()} == {(0, 14, 3), (1, 13, 3), (2, 13, 3)}
    assert sorted(r.v for r in manifest.read_shard(spark, path, 1, digest).collect()) == list(range(1, 40, 3))
    with pytest.raises(ValueError, match="another manifest"):
        manifest.read_shard(spark, path, 1, "0")
    with pytest.raises(ValueError, match="no shard"):
        manifest.read_shard(spark, path, 7, digest)
    with pytest.raises(ValueError, match="their parent"):
        manifest.write_shard_manifests(sharded.filter("v > 0"), scratch_path(spark, "shards"), parent)
    # A row that moved to another shard, and a header that is gone.
    fewer = spark.read.parquet(f"{path}/samples").filter("shard = 1 AND v < 30").select("sample_id", "v").collect()
    spark.createDataFrame(fewer, whole.schema).write.mode("overwrite").parquet(f"{path}/samples/shard=1")
    with pytest.raises(ValueError, match="do not match"):
        manifest.read_shard(spark, path, 1, digest)
    kept = headers.filter("shard <> 2").collect()
    spark.createDataFrame(kept, headers.schema).write.mode("overwrite").json(f"{path}/headers")
    with pytest.raises(ValueError, match="belong together"):
        manifest.read_shard(spark, path, 0, digest)
