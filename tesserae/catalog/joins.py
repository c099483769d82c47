"""Registered queries: joins between questions, images, files, archives and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.functions import prompts
from tesserae.operators import joins as ops
from tesserae.operators import sets
from tesserae.operators.cache import with_cache
from tesserae.runtime import scratch_path, table

_DOC = "doc_id"


@query("jn_slide_map", sql.using("qa", body="""
SELECT sample_id, case_id, CASE WHEN doc_id % 3 = 0 THEN case_id ELSE 'slide_' || doc_id || '.v1' END AS image_id,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/slides/' || source || '/slide_' || doc_id || '.v1.svs' END AS image_path,
  doc_id % 3 = 0 AS unmapped
FROM (SELECT *, 'case-' || doc_id AS case_id FROM qa)"""))
def jn_slide_map(spark: SparkSession, sf: str) -> DataFrame:
    case_id = F.concat(F.lit("case-"), F.col(_DOC).cast("string"))
    rows = fx.qa(spark, sf).select("sample_id", case_id.alias("case_id"))
    slide_map = table(spark, sf, "documents").filter(F.col(_DOC) % 3 != 0).select(
        case_id.alias("case_id"),
        F.concat("source", F.lit("/slide_"), F.col(_DOC).cast("string"), F.lit(".v1.svs")).alias("slide_file"),
    )
    return ops.map_cases(rows, slide_map, "/slides/", require=True)


@query("jn_prefix", """
SELECT d.long_id, d.short_id, q.sample_id FROM (
  SELECT 'CASE-' || lpad(doc_id::VARCHAR, 7, '0') || CASE WHEN doc_id % 3 = 0 THEN '-BS1' ELSE '-DX1' END AS long_id,
    'CASE-' || lpad(doc_id::VARCHAR, 7, '0') AS short_id, doc_id FROM documents) d
JOIN (SELECT conv_id || ':' || turn AS sample_id, 'CASE-' || lpad(conv_id::VARCHAR, 7, '0') AS short_id
      FROM conversations) q USING (short_id) WHERE d.doc_id % 3 <> 0""")
def jn_prefix(spark: SparkSession, sf: str) -> DataFrame:
    case = lambda c: F.concat(F.lit("CASE-"), F.lpad(F.col(c).cast("string"), 7, "0"))
    dirs = table(spark, sf, "documents").select(
        F.concat(case(_DOC), F.when(F.col(_DOC) % 3 == 0, "-BS1").otherwise("-DX1")).alias("long_id")
    )
    questions = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("sample_id"),
        case("conv_id").alias("short_id"),
    )
    return ops.prefix_join(dirs, questions).select("long_id", "short_id", "sample_id")


@query("jn_present", sql.using("qa", "files", body="""
SELECT sample_id, img FROM qa WHERE img IN (SELECT img FROM files)"""))
def jn_present(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.files(spark, sf).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return ops.keep_present(
        fx.qa(spark, sf).select("sample_id", "img"), names, slide="img", marker=None
    ).select("sample_id", "img")


@query("jn_results", sql.using("qa", "predictions", "judged", body="""
SELECT sample_id, missing, NOT missing AND NOT valid AS invalid, pred_answer, true AS in_manifest FROM judged_p
UNION ALL SELECT 'extra:' || item_id, false, false, text, false FROM benchmark"""))
def jn_results(spark: SparkSession, sf: str) -> DataFrame:
    manifest = fx.manifest(spark, sf).select("sample_id")
    extra = table(spark, sf, "benchmark").select(
        F.concat(F.lit("extra:"), F.col("item_id").cast("string")).alias("sample_id"),
        F.lit("ok").alias("status"), F.col("text").alias("pred_answer"),
    )
    results = fx.predictions(spark, sf).select("sample_id", "status", "pred_answer").unionByName(extra)
    inside = ops.join_results(manifest, results).drop("valid").withColumn("in_manifest", F.lit(True))
    no = F.lit(False)
    outside = ops.outside_manifest(manifest, results).select(
        "sample_id", no.alias("missing"), no.alias("invalid"), "pred_answer", no.alias("in_manifest")
    )
    return inside.unionByName(outside)


@query("jn_coverage", sql.using("regions", body="""
SELECT image_id, region_id, true AS in_regions, vec_id % 19 <> 3 AS in_descriptions, vec_id % 23 <> 5 AS in_features,
  'keys' AS problem FROM regions WHERE vec_id % 19 = 3 OR vec_id % 23 = 5
UNION ALL SELECT image_id, region_id || 'x', false, true, false, 'keys' FROM regions WHERE vec_id % 29 = 7
UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, 'scale' FROM regions GROUP BY image_id
  HAVING count(DISTINCT CASE WHEN vec_id % 31 = 0 THEN 10 ELSE 5 END) > 1"""))
def jn_coverage(spark: SparkSession, sf: str) -> DataFrame:
    r, v = fx.regions(spark, sf), F.col("vec_id")
    strange = r.filter(v % 29 == 7).withColumn("region_id", F.concat("region_id", F.lit("x")))
    sides = {
        "regions": r,
        "descriptions": r.filter(v % 19 != 3).unionByName(strange),
        "features": r.filter(v % 23 != 5),
    }
    keys = ops.key_mismatches(sides, ["image_id", "region_id"]).withColumn("problem", F.lit("keys"))
    mixed = ops.scales_per_image(r.withColumn("scale", F.when(v % 31 == 0, 10.0).otherwise(5.0)))
    return keys.unionByName(mixed.withColumn("problem", F.lit("scale")), allowMissingColumns=True)


@query("jn_suffix", sql.using("originals", body="""
SELECT name, original, CASE WHEN doc_id % 6 = 5 THEN 0 WHEN doc_id % 6 = 4 THEN 2 ELSE 1 END AS candidates,
  CASE doc_id % 6 WHEN 0 THEN original WHEN 1 THEN substr(original, 5) WHEN 2 THEN 'deep/er/' || original
    WHEN 3 THEN 'x/' || substr(original, 5) END AS member,
  CASE WHEN doc_id % 6 = 5 THEN 'missing' WHEN doc_id % 6 = 4 THEN 'ambiguous' ELSE 'matched' END AS status
FROM originals"""))
def jn_suffix(spark: SparkSession, sf: str) -> DataFrame:
    wanted, kind = fx.originals(spark, sf), F.col(_DOC) % 6
    tail = F.expr("substring(original, 5)")
    placed = (
        F.when(kind == 0, F.array("original"))
        .when(kind == 1, F.array(tail))
        .when(kind == 2, F.array(F.concat(F.lit("deep/er/"), F.col("original"))))
        .when(kind == 3, F.array(F.concat(F.lit("x/"), tail)))
        .when(kind == 4, F.array(F.concat(F.lit("a/"), F.col("original")), F.concat(F.lit("b/"), tail)))
        # Looks similar but does not end on a folder boundary.
        .otherwise(F.array(F.concat(F.lit("a/x"), tail)))
    )
    members = wanted.select(F.explode(placed).alias("member"))
    return ops.match_members(wanted.select("name", "original"), members).drop("tail")


@query("jn_suffix_candidates", sql.using("originals", body="""
SELECT substr(original, 5) AS tail, unnest(['a/' || original, 'b/' || substr(original, 5)]) AS member
FROM originals WHERE doc_id % 6 = 4"""))
def jn_suffix_candidates(spark: SparkSession, sf: str) -> DataFrame:
    wanted, kind = fx.originals(spark, sf), F.col(_DOC) % 6
    tail = F.expr("substring(original, 5)")
    placed = F.when(
        kind == 4, F.array(F.concat(F.lit("a/"), F.col("original")), F.concat(F.lit("b/"), tail))
    ).otherwise(F.array("original"))
    members = wanted.select(F.explode(placed).alias("member"))
    matched = ops.match_members(wanted.select("name", "original"), members)
    return ops.ambiguous_members(matched, members)


_INVENTORY = """inventory AS (
  SELECT lang AS cohort, 'slide_' || doc_id AS slide_id, 'remote/' || lang || '/slide_' || doc_id || '.svs' AS path,
    n_chars AS size, doc_id FROM documents WHERE doc_id % 8 <> 3
  UNION ALL SELECT lang, 'slide_' || doc_id, 'remote/again/slide_' || doc_id || '.svs', n_chars, doc_id
  FROM documents WHERE doc_id % 9 = 4 AND doc_id % 8 <> 3)"""


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter(F.col(_DOC) % 8 != 3)
    name = F.concat(F.lit("slide_"), F.col(_DOC).cast("string"), F.when(F.col(_DOC) % 2 == 0, ".svs").otherwise(".SVS"))
    places = F.when(F.col(_DOC) % 9 == 4, F.array(F.col("lang"), F.lit("again"))).otherwise(F.array("lang"))
    listed = d.select(
        F.col("lang").alias("cohort"), F.explode(places).alias("_p"), name.alias("basename"),
        F.when(F.col(_DOC) % 3 == 0, "symbolic_link").otherwise(" file").alias("type"),
        F.col("n_chars").cast("string").alias("size"),
    ).withColumn("path", F.concat(F.lit("remote/"), "_p", F.lit("/"), "basename")).drop("_p")
    notes = d.select(
        F.col("lang").alias("cohort"), F.concat(F.lit("slide_"), F.col(_DOC).cast("string"), F.lit(".txt")).alias("basename"),
        F.lit("file").alias("type"), F.lit("1").alias("size"), F.lit("remote/notes").alias("path"),
    )
    return listed.unionByName(notes)


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("lang").alias("cohort"), F.concat(F.lit("slide_"), F.col(_DOC).cast("string")).alias("slide_id")
    )


@query("jn_inventory", f"""WITH {_INVENTORY}
SELECT w.cohort, w.slide_id, count(i.path) AS matches,
  CASE WHEN count(i.path) = 1 THEN min(size) END AS size_bytes
FROM (SELECT lang AS cohort, 'slide_' || doc_id AS slide_id FROM documents) w
LEFT JOIN inventory i USING (cohort, slide_id) GROUP BY w.cohort, w.slide_id""")
def jn_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return ops.match_inventory(_wanted(spark, sf), _inventory(spark, sf)).drop("remote_path")


@query("jn_inventory_failures", f"""WITH {_INVENTORY}
SELECT matches, count(*) AS slides FROM (
  SELECT w.doc_id, count(i.path) AS matches FROM documents w
  LEFT JOIN inventory i USING (doc_id) GROUP BY w.doc_id) WHERE matches <> 1 GROUP BY matches""")
def jn_inventory_failures(spark: SparkSession, sf: str) -> DataFrame:
    return ops.match_failures(ops.match_inventory(_wanted(spark, sf), _inventory(spark, sf)))


@query("jn_choose_package", """
SELECT lang AS cohort, CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN 'p2' ELSE 'p3' END AS package_id
FROM (SELECT DISTINCT lang FROM documents)""")
def jn_choose_package(spark: SparkSession, sf: str) -> DataFrame:
    """Package 1 lacks slides everywhere, 2 is whole for one cohort, 3 doubles one cohort."""
    d = table(spark, sf, "documents")
    base = d.select(
        F.col("lang").alias("cohort"), _DOC,
        F.concat(F.lit("slide_"), F.col(_DOC).cast("string"), F.lit(".svs")).alias("basename"),
        F.lit("file").alias("type"),
    )
    first = base.filter(F.col(_DOC) % 2 == 0).withColumns({"package_id": F.lit("p1"), "rank": F.lit(1)})
    second = base.filter((F.col("cohort") == "de") | (F.col(_DOC) % 3 == 0)).withColumns(
        {"package_id": F.lit("p2"), "rank": F.lit(2)}
    )
    copies = F.when(F.col("cohort") == "fr", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    third = base.withColumn("_c", F.explode(copies)).drop("_c").withColumns(
        {"package_id": F.lit("p3"), "rank": F.lit(3)}
    )
    packages = first.unionByName(second).unionByName(third)
    return ops.choose_package(_wanted(spark, sf), packages)


@query("jn_verify_sizes", sql.using("files", body="""
SELECT d.doc_id AS file_id, d.n_chars AS expected_size, count(f.path) AS n_files,
  count(*) FILTER (WHERE f.size = d.n_chars) AS n_exact,
  CASE WHEN count(*) FILTER (WHERE f.size = d.n_chars) = 1 THEN min(f.path) FILTER (WHERE f.size = d.n_chars) END AS path,
  count(*) FILTER (WHERE f.size = d.n_chars) = 1 AS complete
FROM documents d LEFT JOIN files f USING (doc_id) GROUP BY d.doc_id, d.n_chars"""))
def jn_verify_sizes(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "documents").select(
        F.col(_DOC).alias("file_id"), F.col("n_chars").alias("expected_size")
    )
    return ops.verify_files(expected, fx.files(spark, sf).withColumnRenamed(_DOC, "file_id"))


@query("jn_verify_totals", sql.using("files", body="""
SELECT count(*) AS expected, count(*) FILTER (WHERE n = 1) AS complete, count(*) FILTER (WHERE n <> 1) AS problems,
  coalesce(sum(n_chars) FILTER (WHERE n = 1), 0)::BIGINT AS bytes_complete
FROM (SELECT d.doc_id, d.n_chars, count(*) FILTER (WHERE f.size = d.n_chars) AS n
  FROM documents d LEFT JOIN files f USING (doc_id) GROUP BY d.doc_id, d.n_chars)"""))
def jn_verify_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.verify_totals(jn_verify_sizes(spark, sf))


_ANNOTATIONS = """annotations AS (
  SELECT source, split, 'img_' || (doc_id - doc_id % 3) AS img, 'pre/' || doc_id AS source_img, doc_id AS position
  FROM qa)"""


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    return fx.qa(spark, sf).select(
        "source", "split",
        F.concat(F.lit("img_"), (F.col(_DOC) - F.col(_DOC) % 3).cast("string")).alias("img"),
        F.concat(F.lit("pre/"), F.col(_DOC).cast("string")).alias("source_img"),
        F.col(_DOC).alias("position"),
    ).withColumn("split", F.when(F.col("position") % 4 == 1, "val").otherwise(F.col("split")))


_ANNOTATIONS = _ANNOTATIONS.replace(
    "SELECT source, split,", "SELECT source, CASE WHEN doc_id % 4 = 1 THEN 'val' ELSE split END AS split,"
)


@query("jn_audit", sql.using("qa", "files", _ANNOTATIONS, body="""
SELECT source, any_value(q) AS questions, any_value(t) AS test_questions, count(*) AS all_images,
  count(*) FILTER (WHERE present) AS all_images_present, count(*) FILTER (WHERE in_test) AS test_images,
  count(*) FILTER (WHERE in_test AND present) AS test_images_present
FROM (SELECT source, img, bool_or(split <> 'val') AS in_test, img IN (SELECT img FROM files WHERE size > 0) AS present
      FROM annotations GROUP BY source, img)
JOIN (SELECT source, count(*) AS q, count(*) FILTER (WHERE split <> 'val') AS t FROM annotations GROUP BY source)
USING (source) GROUP BY source"""))
def jn_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ops.audit_coverage(_annotations(spark, sf), fx.files(spark, sf))


@query("jn_audit_splits", sql.using("qa", _ANNOTATIONS, body="""
SELECT source, split, count(*) AS questions FROM annotations GROUP BY ROLLUP (source, split)"""))
def jn_audit_splits(spark: SparkSession, sf: str) -> DataFrame:
    return ops.split_counts(_annotations(spark, sf))


@query("jn_audit_totals", sql.using("qa", "files", _ANNOTATIONS, body="""
SELECT sum(q)::BIGINT AS questions, sum(t)::BIGINT AS test_questions, sum(a)::BIGINT AS all_images, sum(p)::BIGINT AS all_images_present,
  sum(i)::BIGINT AS test_images, sum(ip)::BIGINT AS test_images_present, sum(a) = sum(p) AS complete
FROM (SELECT source, count(*) AS a, count(*) FILTER (WHERE present) AS p, count(*) FILTER (WHERE in_test) AS i,
        count(*) FILTER (WHERE in_test AND present) AS ip
      FROM (SELECT source, img, bool_or(split <> 'val') AS in_test, img IN (SELECT img FROM files WHERE size > 0) AS present
            FROM annotations GROUP BY source, img) GROUP BY source)
JOIN (SELECT source, count(*) AS q, count(*) FILTER (WHERE split <> 'val') AS t FROM annotations GROUP BY source) USING (source)"""))
def jn_audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ops.audit_totals(ops.audit_coverage(_annotations(spark, sf), fx.files(spark, sf)))


@query("jn_audit_missing", sql.using("qa", "files", _ANNOTATIONS, body="""
SELECT source, img, arg_max(source_img, position) AS source_img, bool_or(split <> 'val') AS in_test
FROM annotations WHERE img NOT IN (SELECT img FROM files WHERE size > 0) GROUP BY source, img"""))
def jn_audit_missing(spark: SparkSession, sf: str) -> DataFrame:
    return ops.image_presence(_annotations(spark, sf), fx.files(spark, sf)).filter("NOT present").drop("present")


@query("jn_pending", sql.using("qa", "predictions", body="""
SELECT 'legacy' AS rule, sample_id FROM qa WHERE sample_id NOT IN (SELECT sample_id FROM predictions WHERE status = 'ok')
UNION ALL SELECT 'newer', sample_id FROM qa WHERE sample_id NOT IN (SELECT sample_id FROM predictions)"""))
def jn_pending(spark: SparkSession, sf: str) -> DataFrame:
    work, results = fx.manifest(spark, sf).select("sample_id"), fx.predictions(spark, sf)
    legacy = ops.pending(work, results, prompts.LEGACY).withColumn("rule", F.lit("legacy"))
    return legacy.unionByName(ops.pending(work, results, prompts.PAPER).withColumn("rule", F.lit("newer")))


@query("jn_pending_groups", sql.using("qa", "predictions", body="""
SELECT rule, source, total, done FROM (
  SELECT source, count(*) AS total, count(p.sample_id) + CASE WHEN source = 'src3' THEN 10000000 WHEN source = 'src4'
    THEN count(*) - count(p.sample_id) ELSE 0 END AS done
  FROM qa LEFT JOIN predictions p USING (sample_id) GROUP BY source), (VALUES ('at_least'), ('exact')) r(rule)
WHERE CASE WHEN source = 'src3' THEN false WHEN rule = 'exact' THEN done <> total ELSE done < total END"""))
def jn_pending_groups(spark: SparkSession, sf: str) -> DataFrame:
    work = fx.qa(spark, sf).select("sample_id", "source").filter("source <> 'src3'")
    done = fx.predictions(spark, sf).select("sample_id").join(work, "sample_id")
    done = done.filter("source <> 'src4'").unionByName(work.filter("source = 'src4'"))
    at_least = ops.pending_groups(work, done, "source").withColumn("rule", F.lit("at_least"))
    exact = ops.pending_groups(work, done, "source", exact=True).withColumn("rule", F.lit("exact"))
    return at_least.unionByName(exact)


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions as results of 16 runs; one run carries some foreign hashes, one lacks some."""
    run = F.concat(F.lit("shard_"), F.col("shard").cast("string"))
    odd = (F.col("shard") == 5) & (F.col(_DOC) % 3 == 0)
    none = (F.col("shard") == 6) & (F.col(_DOC) % 5 == 0)
    return fx.predictions(spark, sf).select(
        "sample_id", run.alias("run"),
        F.when(odd, "other").when(~none, F.concat(F.lit("hash_"), F.col("shard").cast("string"))).alias("run_hash"),
    )


def run_locks(spark: SparkSession, sf: str) -> DataFrame:
    """Locks of all runs but one."""
    shard = (F.col(_DOC) % 16).cast("string")
    return table(spark, sf, "documents").filter(F.col(_DOC) % 16 != 7).select(
        F.concat(F.lit("shard_"), shard).alias("run"), F.concat(F.lit("hash_"), shard).alias("lock_hash"),
        F.lit("config0").alias("config_hash"),
        F.when(F.col(_DOC) % 16 == 9, "code1").otherwise("code0").alias("code_hash"),
    ).distinct()


@query("jn_identity", sql.using("qa", "predictions", body="""
SELECT run, coalesce(n, 0) AS results, coalesce(bad, 0) AS mismatched, true AS one_config, false AS one_code
FROM (SELECT DISTINCT 'shard_' || (doc_id % 16) AS run FROM documents WHERE doc_id % 16 <> 7)
FULL JOIN (SELECT 'shard_' || shard AS run, count(*) AS n,
             count(*) FILTER (WHERE shard = 5 AND doc_id % 3 = 0 OR shard = 6 AND doc_id % 5 = 0 OR shard = 7) AS bad
           FROM predictions GROUP BY shard) USING (run)"""))
def jn_identity(spark: SparkSession, sf: str) -> DataFrame:
    return ops.check_identity(run_results(spark, sf), run_locks(spark, sf))


@query("jn_attest", """
SELECT c_custkey AS run, field, found, required FROM (
  SELECT c_custkey, 'dataset' AS field, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'demo' END AS found, 'demo' AS required FROM customer
  UNION ALL SELECT c_custkey, 'passed', CASE WHEN c_custkey % 11 = 0 THEN 'false' ELSE 'true' END, 'true' FROM customer
  UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END, c_mktsegment FROM customer)
WHERE found IS DISTINCT FROM required""")
def jn_attest(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    profile = table(spark, sf, "customer").select(
        c.alias("run"), F.when(c % 7 == 0, "other").otherwise("demo").alias("dataset"),
        (c % 11 != 0).alias("passed"), F.when(c % 13 != 0, F.col("c_mktsegment")).alias("segment"),
        "c_mktsegment",
    )
    return ops.attest(profile, {
        "dataset": F.lit("demo"), "passed": F.lit(True), "segment": F.col("c_mktsegment"),
    })


@query("jn_cache", f"""
WITH keyed AS (
  SELECT doc_id, text, source, sha256('{{"mpp": "0.5", "text": ' || {sql.js('text')} || '}}') AS cache_key FROM documents),
old AS (SELECT cache_key, max('old:' || source) AS value FROM keyed WHERE doc_id % 2 = 0 GROUP BY cache_key)
SELECT doc_id, cache_key, coalesce(value, 'new:' || cache_key) AS value, value IS NOT NULL AS hit
FROM keyed LEFT JOIN old USING (cache_key)""")
def jn_cache(spark: SparkSession, sf: str) -> DataFrame:
    from tesserae.operators.cache import cache_key

    inputs = table(spark, sf, "documents").select(_DOC, "text", "source", F.lit(0.5).alias("mpp"))
    keys = ["text", "mpp"]
    old = cache_key(inputs.filter(F.col(_DOC) % 2 == 0), keys).groupBy("cache_key").agg(
        F.max(F.concat(F.lit("old:"), "source")).alias("value")
    )
    compute = lambda misses: misses.withColumn("value", F.concat(F.lit("new:"), "cache_key"))
    found, _ = with_cache(inputs, old, keys, compute)
    return found.select(_DOC, "cache_key", "value", "hit")


@query("jn_cache_inventory", """
WITH keyed AS (
  SELECT doc_id, sha256(text) AS image_sha256,
    sha256('{"image_sha256": "' || sha256(text) || '", "mpp": "0.5", "path": "p/' || doc_id || '"}') AS cache_key FROM documents),
hashed AS (
  SELECT doc_id, sha256('["r' || k || '", "' || substr(cache_key, 1, 8) || ':' || k || '"]') AS h, length(k::VARCHAR) + 9 AS b
  FROM keyed, range(3) r(k)),
parts AS (SELECT doc_id, substr(h, 1, 2) AS p, count(*) AS n, sum(b) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM hashed GROUP BY ALL),
whole AS (SELECT doc_id, sum(n)::BIGINT AS regions, sum(b)::BIGINT AS value_bytes, sha256(string_agg(h, '' ORDER BY h)) AS content_sha256 FROM parts GROUP BY 1)
SELECT 'img_' || doc_id AS image_id, cache_key, 'p/' || doc_id AS path, image_sha256, regions, value_bytes, content_sha256,
  CASE WHEN doc_id % 10 = 0 THEN 'recomputed' WHEN doc_id % 2 = 0 THEN 'hit' ELSE 'computed' END AS state
FROM keyed JOIN whole USING (doc_id)""")
def jn_cache_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the images are observed; then some of what was stored is changed, and all are
    observed: what doesn't match its inventory is made again."""
    from tesserae.operators.cache import ObservationCache

    name = F.col(_DOC).cast("string")
    images = table(spark, sf, "documents").select(
        _DOC, F.concat(F.lit("img_"), name).alias("image_id"), F.concat(F.lit("p/"), name).alias("path"),
        F.sha2("text", 256).alias("image_sha256"), F.lit(0.5).alias("mpp"),
    )
    root, keys = scratch_path(spark, "observations"), ["path", "image_sha256", "mpp"]

    def compute(missing: DataFrame) -> DataFrame:
        regions = missing.select("cache_key", F.explode(F.array(*[F.lit(str(k)) for k in range(3)])).alias("k"))
        value = F.concat_ws(":", F.substring("cache_key", 1, 8), "k")
        return regions.select("cache_key", F.concat(F.lit("r"), "k").alias("region_id"), value.alias("value"))

    cache = ObservationCache(spark, root)
    cache.observe(images.filter(F.col(_DOC) % 2 == 0), keys, compute)
    changed = cache.inventory().filter("image_id LIKE '%0'").select("cache_key", F.lit(True).alias("changed"))
    entries = spark.read.parquet(f"{root}/entries/batch=1").join(changed, "cache_key", "left")
    odd = F.when(F.col("changed") & (F.col("region_id") == "r1"), F.lit("tampered")).otherwise(F.col("value"))
    entries.select("cache_key", "region_id", odd.alias("value")).write.parquet(f"{root}/other")
    spark.read.parquet(f"{root}/other").write.mode("overwrite").parquet(f"{root}/entries/batch=1")
    states = cache.observe(images, keys, compute)
    facts = cache.inventory().drop("batch", "image_id")
    return states.join(facts, "cache_key")


@query("set_assemble", """
WITH parts AS (
  SELECT doc_id, lang, NULL AS source, 'a' AS origin FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, NULL, source, 'b' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, lang, source, 'c' FROM documents WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, lang, source, 'c' FROM documents WHERE doc_id % 35 = 1),
counted AS (SELECT doc_id, origin, count(*) AS n FROM parts GROUP BY ALL),
repeated AS (
  SELECT doc_id, string_agg(origin || CASE WHEN n > 1 THEN ' x ' || n ELSE '' END, ', ' ORDER BY origin) AS conflict
  FROM counted GROUP BY 1 HAVING sum(n) > 1)
SELECT p.doc_id, lang, source, origin, conflict FROM parts p LEFT JOIN repeated USING (doc_id)""")
def set_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Three parts with different columns and common documents; one part has some rows twice."""
    d, i = table(spark, sf, "documents").select(_DOC, "lang", "source"), F.col(_DOC)
    third = d.filter(i % 5 == 1)
    parts = {
        "a": d.filter(i % 2 == 0).drop("source"),
        "b": d.filter(i % 3 == 0).drop("lang"),
        "c": third.unionByName(third.filter(i % 35 == 1)),
    }
    return sets.assemble(parts, [_DOC]).withColumn("conflict", F.array_join("conflict", ", "))


@query("set_diff", """
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 3 FROM labels)
UNION ALL SELECT doc_id + 3, 'right' FROM labels WHERE doc_id + 3 NOT IN (SELECT doc_id FROM documents)""")
def set_diff(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select((F.col(_DOC) + 3).alias(_DOC))
    return sets.set_diff(table(spark, sf, "documents"), labels, _DOC)


@query("set_merge_report", """
WITH prev AS (SELECT 'img_' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'd0' ELSE 'd1' END AS dg,
    'prev ' || n_chars AS detail FROM documents WHERE doc_id % 2 = 0),
cur AS (SELECT 'img_' || doc_id AS name, 'cur ' || source AS detail FROM documents WHERE doc_id % 3 = 0),
restored AS (SELECT coalesce(c.name, p.name) AS name, coalesce(c.detail, p.detail) AS detail
  FROM (SELECT * FROM prev WHERE dg = 'd1') p FULL JOIN cur c ON p.name = c.name)
SELECT name, 'restored' AS status, detail FROM restored
UNION ALL SELECT 'img_' || doc_id, 'already_present', NULL FROM documents
WHERE doc_id % 7 IN (1, 2) AND 'img_' || doc_id NOT IN (SELECT name FROM restored)""")
def set_merge_report(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col(_DOC)
    name = F.concat(F.lit("img_"), i.cast("string")).alias("name")
    previous = d.filter(i % 2 == 0).select(
        name, F.when(i % 5 == 0, "d0").otherwise("d1").alias("source_digest"),
        F.concat(F.lit("prev "), F.col("n_chars").cast("string")).alias("detail"),
    )
    current = d.filter(i % 3 == 0).select(
        name, F.lit("d1").alias("source_digest"), F.concat(F.lit("cur "), F.col("source")).alias("detail")
    )
    present = d.filter((i % 7).isin(1, 2)).select(name)
    return sets.merge_report(previous, current, present)


@query("agg_duplicates", f"""
SELECT identity, count(*) AS copies FROM (
  SELECT sha256('[' || {sql.js("'s'")} || ', ' || {sql.js('text')} || ']') AS identity FROM documents)
GROUP BY identity HAVING count(*) > 1""")
def agg_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from tesserae.functions.digest import digest_list

    rows = table(spark, sf, "documents").select(digest_list(F.lit("s"), F.col("text")).alias("identity"))
    return sets.find_duplicates(rows, ["identity"])


@query("agg_conflicts", """
SELECT sha256(text) AS name, min(source) AS first_value, max(source) AS last_value
FROM documents GROUP BY text HAVING min(source) <> max(source)""")
def agg_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.sha2("text", 256).alias("name"), "source")
    return sets.find_conflicts(rows, "name", "source")
