import pytest
from pyspark.sql import functions as F

from tesserae.functions.choices import choices_from_columns
from tesserae.operators import joins, samples, scoring
from tesserae.operators.cache import cache_key
from tesserae.plans.evaluate import evaluate
from tesserae.plans.manifest import build_manifest
from tesserae.runtime import scratch_path
from tesserae.sources import manifest
from tesserae.sources.manifest import manifest_digest, read_manifest, write_manifest


def make(spark, n, task="ER"):
    rows = spark.createDataFrame([(str(i), f"im{i}") for i in range(n)], "sid string, image_id string")
    choices = choices_from_columns(("A", F.lit("yes")), ("B", F.lit("no")))
    ready = rows.withColumns({"question": F.lit("Which?"), "choices": choices, "answer": F.lit("A"),
                              "task": F.lit(task)})
    return samples.make_samples(ready, "test", "test")


RESULT = "sample_id string, status string, pred_answer string, run_hash string, run string"


def results(spark, run="r0"):
    return spark.createDataFrame(
        [("test:0", "ok", "A", "h", run), ("test:1", "ok", "", "h", run), ("test:2", "invalid", "A", "h", run)], RESULT)


def test_denominator_is_the_manifest(spark):
    manifest = make(spark, 4)
    closed = {r.group: r for r in scoring.score_closed(manifest, results(spark)).collect()}
    assert set(closed) == {"closed_overall", "task:ER", "paper_group:Receptor"}
    assert closed["closed_overall"].accuracy_percent == 25 and closed["closed_overall"].total == 4
    counters = scoring.score_counters(manifest, results(spark)).first()
    assert (counters.missing, counters.invalid, counters.complete, counters.received) == (1, 1, False, 3)


def test_evaluate_refuses_foreign_results(spark):
    manifest = make(spark, 4)
    locks = spark.createDataFrame([("r0", "h", "c", "s")], "run string, lock_hash string, config_hash string, code_hash string")
    metrics = evaluate(manifest, results(spark), locks)
    assert metrics.counters.first().expected == 4
    with pytest.raises(ValueError, match="outside"):
        evaluate(make(spark, 2), results(spark), locks)
    with pytest.raises(ValueError, match="repeated"):
        evaluate(manifest, results(spark).union(results(spark)), locks)
    with pytest.raises(ValueError, match="identity"):
        evaluate(manifest, results(spark), locks.withColumn("lock_hash", F.lit("other")))
    two = locks.union(spark.createDataFrame([("r1", "h", "c", "s2")], locks.schema))
    with pytest.raises(ValueError, match="identity"):
        evaluate(manifest, results(spark), two)


def test_manifest_digest_and_tampering(spark):
    path = scratch_path(spark, "m")
    manifest = make(spark, 9)
    write_manifest(manifest, path, purpose="full")
    assert read_manifest(spark, path).count() == 9
    assert manifest_digest(manifest.repartition(5)).first() == manifest_digest(manifest).first()
    changed = manifest.withColumn("question", F.when(F.col("sample_id") == "test:3", "tampered").otherwise(F.col("question")))
    assert manifest_digest(changed).first().digest != manifest_digest(manifest).first().digest
    changed.write.mode("overwrite").parquet(f"{path}/samples")
    with pytest.raises(ValueError, match="digest"):
        read_manifest(spark, path)
    with pytest.raises(ValueError, match="empty"):
        write_manifest(manifest.limit(0), scratch_path(spark, "m"))
    with pytest.raises(ValueError, match="repeated"):
        write_manifest(manifest.union(manifest), scratch_path(spark, "m"))


def test_build_manifest(spark):
    index = spark.createDataFrame([(f"im{i}", f"/p/im{i}.svs") for i in range(4)], "image_id string, path string")
    rejected = build_manifest(make(spark, 4), scratch_path(spark, "b"), index, 4, 4)
    assert rejected.count() == 0
    with pytest.raises(ValueError, match="size"):
        build_manifest(make(spark, 4), scratch_path(spark, "b"), index, 5, 4)
    double = index.union(spark.createDataFrame([("im1", "/q/im1.svs")], index.schema))
    with pytest.raises(ValueError, match="exactly once"):
        build_manifest(make(spark, 4), scratch_path(spark, "b"), double)
    bad = make(spark, 4).withColumn("question", F.lit("  "))
    with pytest.raises(ValueError, match="rejected"):
        build_manifest(bad, scratch_path(spark, "b"))


def test_gold_never_reaches_a_model(spark):
    public = samples.public_input(make(spark, 1))
    assert not {"ground_truth", "ground_truth_label"} & set(public.columns)
    with pytest.raises(ValueError):
        samples.require_public(make(spark, 1))


@pytest.mark.parametrize("path,safe", [("a/b.jpg", True), ("a/../b", True), ("../b", False), ("a/../../b", False), ("/b", False), ("./a", True)])
def test_paths_stay_inside(spark, path, safe):
    assert spark.range(1).select(samples.is_inside(F.lit(path))).first()[0] is safe


def test_archive_members(spark):
    mapping = spark.createDataFrame([("a.jpg", "pre/x/1.tif"), ("b.jpg", "pre/y/1.tif"), ("c.jpg", "pre/z/9.tif")], "name string, original string")
    members = spark.createDataFrame([("pre/x/1.tif",), ("deep/y/1.tif",), ("other/y/1.tif",), ("zz/9.tif",)], "member string")
    matched = joins.match_members(mapping, members)
    assert {r.name: (r.status, r.candidates, r.member) for r in matched.collect()} == {
        "a.jpg": ("matched", 1, "pre/x/1.tif"), "b.jpg": ("ambiguous", 2, None), "c.jpg": ("missing", 0, None)}
    assert {r.member for r in joins.ambiguous_members(matched, members).collect()} == {"deep/y/1.tif", "other/y/1.tif"}


def test_pending_rules(spark):
    work, done = make(spark, 4).select("sample_id"), results(spark)
    ids = lambda protocol: {r.sample_id for r in joins.pending(work, done, protocol).collect()}
    assert ids("legacy-v1") == {"test:2", "test:3"}
    assert ids("paper-prompts-nonthinking-2x-v1") == {"test:3"}


def test_result_files_of_many_runs(spark):
    from tesserae.sources.results import checked_results, read_results, write_results

    root = scratch_path(spark, "runs")
    first = results(spark).drop("run")
    second = first.withColumn("sample_id", F.concat("sample_id", F.lit("b"))).withColumn("run_hash", F.lit("h2"))
    write_results(first, root, "r0")
    write_results(second, root, "r1")
    read = read_results(spark, root)
    assert {(r.sample_id, r.run, r.run_hash) for r in read.collect()} == {
        *((f"test:{i}", "r0", "h") for i in range(3)), *((f"test:{i}b", "r1", "h2") for i in range(3))}
    locks = spark.createDataFrame([("r0", "h", "c", "s"), ("r1", "h2", "c", "s")],
                                  "run string, lock_hash string, config_hash string, code_hash string")
    assert checked_results(read, locks).count() == 6
    write_results(first, root, "r1")
    with pytest.raises(ValueError, match="repeated"):
        checked_results(read_results(spark, root), locks)


def test_result_files_written_in_one_job(spark):
    from tesserae.sources.results import read_results, write_run_results

    root = scratch_path(spark, "runs")
    rows = results(spark).withColumn("run", F.concat(F.lit("r_"), F.substring("sample_id", -1, 1)))
    write_run_results(rows, root)
    assert {(r.sample_id, r.run) for r in read_results(spark, root).collect()} == {(f"test:{i}", f"r_{i}") for i in range(3)}


def test_digests_tell_containers_apart(spark):
    kinds = {
        "array<string>": ["array('a, b')", "array('a', 'b')", "array(null)", "array('null')", "array()", "null"],
        "map<string,int>": ["map('a', 1, 'b', 2)", "map('a', 12)", "map('a: 1, b', 2)"],
        "struct<x:string,y:array<int>>": ["named_struct('x', 'p', 'y', array(1, 2))", "named_struct('x', 'p, [1', 'y', array(2))"],
    }
    for kind, values in kinds.items():
        rows = None
        for i, value in enumerate(values):
            row = spark.sql(f"SELECT '{i}' AS sample_id, cast({value} AS {kind}) AS v")
            rows = row if rows is None else rows.unionByName(row)
        same_id = rows.withColumn("sample_id", F.lit("s"))
        assert manifest.row_digests(same_id).distinct().count() == len(values)
        assert cache_key(rows, ["v"]).select("cache_key").distinct().count() == len(values)
    turned = spark.sql("SELECT 's' AS sample_id, map('a', 1, 'b', 2) AS v UNION ALL SELECT 's', map('b', 2, 'a', 1)")
    assert manifest.row_digests(turned).distinct().count() == 1
    odd = spark.sql("SELECT 's' AS sample_id, double('nan') AS v")
    with pytest.raises(Exception, match="form in JSON"):
        manifest.row_digests(odd).collect()
