"""Registered queries: readers and writers, over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.joins import run_locks
from tesserae.catalog.registry import query
from tesserae.functions.choices import choices_key
from tesserae.operators.joins import check_identity
from tesserae.operators.sets import find_duplicates
from tesserae.runtime import scratch_path, table
from tesserae.sources import annotations, arrays, descriptions, files, inventory, manifest, payloads, results

_LABELLED = "CASE WHEN closed THEN 'A=' || opt_a || '|B=' || opt_b || '|C=' || opt_c || '|D=' || opt_d ELSE '' END"


def _write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, quoteAll=True, quote='"', escape='"', emptyValue="")


@query("src_slide_qa", sql.using("qa", body=f"""
SELECT 'slides:' || doc_id AS sample_id, source AS image_id, sha256(question) AS question_hash, {_LABELLED} AS choices,
  gold AS ground_truth, CASE WHEN closed THEN gold END AS ground_truth_label, task, '' AS source, 0.5::DOUBLE AS assumed_mpp
FROM qa
UNION ALL
SELECT 'cohorts:' || doc_id, source, sha256(question), {_LABELLED}, gold, CASE WHEN closed THEN gold END,
  CASE WHEN doc_id % 3 = 0 THEN 'Tumor subtype' ELSE task END, task, NULL
FROM qa"""))
def src_slide_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Both table variants, with line breaks and quotes inside questions."""
    rows = fx.qa(spark, sf)
    common = [
        F.col("doc_id").cast("string").alias("ID"),
        F.concat(F.lit(" "), F.col("image_id"), F.lit(" ")).alias("Slide"),
    ]
    tail = [
        F.col("question").alias("Question"),
        *[F.coalesce(F.col(f"opt_{c}"), F.lit(" ")).alias(c.upper()) for c in "abcd"],
        F.col("gold").alias("Answer"),
    ]
    first, second = scratch_path(spark, "slide-qa"), scratch_path(spark, "cohort-qa")
    _write_csv(rows.select(*common, F.col("task").alias("Task"), *tail), first)
    blank = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("task"))
    _write_csv(
        rows.select(*common, F.col("task").alias("Tumor"), blank.alias("Task"), *tail, F.lit("RELEASED").alias("Output")),
        second,
    )
    a = annotations.read_slide_qa_csv(spark, first, "slides", 0.5)
    b = annotations.read_slide_qa_csv(spark, second, "cohorts", cohorts=True)
    return a.unionByName(b).select(
        "sample_id", "image_id", F.sha2("question", 256).alias("question_hash"),
        choices_key(F.col("choices")).alias("choices"), "ground_truth", "ground_truth_label",
        "task", "source", "assumed_mpp",
    )


@query("src_nested_qa", sql.using("qa", body=f"""
SELECT 'nested:' || source || ':' || split || ':' || doc_id AS sample_id, split, img AS image_id,
  'images/' || img AS image_path, sha256(question) AS question_hash, {_LABELLED} AS choices,
  gold AS ground_truth, source, 'roi' AS input_kind FROM qa"""))
def src_nested_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents, one per line, of at most 64 rows each."""
    rows = fx.qa(spark, sf)
    listed = F.filter(F.array(*[F.col(f"opt_{c}") for c in "abcd"]), lambda text: text.isNotNull())
    entry = F.struct(
        F.col("doc_id").alias("No"), "img", "question", listed.alias("options"),
        F.col("gold").alias("answer"), F.concat(F.lit("pre/"), "img").alias("source_img"),
    )
    documents = (
        rows.withColumn("_part", F.floor(F.col("doc_id") / 64))
        .groupBy("source", "split", "_part")
        .agg(F.collect_list(entry).alias("_rows"))
        .select(F.to_json(F.create_map("source", F.create_map("split", "_rows"))).alias("value"))
    )
    path = scratch_path(spark, "nested-qa")
    documents.write.text(path)
    read = annotations.nested_samples(
        annotations.nested_rows(spark.read.text(path)), "nested", "images"
    )
    return read.select(
        "sample_id", "split", "image_id", "image_path", F.sha2("question", 256).alias("question_hash"),
        choices_key(F.col("choices")).alias("choices"), "ground_truth", "source", "input_kind",
    )


@query("src_nested_missing", sql.using("qa", body="""
SELECT source, split FROM (SELECT DISTINCT source FROM qa), (VALUES ('test'), ('test_tiny')) s(split)
WHERE (source, split) NOT IN (SELECT (source, split) FROM qa)"""))
def src_nested_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Mandatory parts that the release does not have."""
    rows = fx.qa(spark, sf).select("source", "split")
    sources = rows.select("source").distinct()
    splits = spark.createDataFrame([("test",), ("test_tiny",)], "split string")
    wanted = sources.crossJoin(F.broadcast(splits))
    return wanted.join(rows.distinct(), ["source", "split"], "left_anti")


@query("src_case_qa", sql.using("qa", body=f"""
SELECT 'cases:' || (doc_id // 100) || ':' || (doc_id % 100) AS sample_id,
  CASE WHEN doc_id % 3 = 0 THEN 'case-' || doc_id ELSE 'slide_' || doc_id END AS image_id,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/slides/slide_' || doc_id || '.svs' END AS image_path,
  sha256(question) AS question_hash, {_LABELLED} AS choices, gold AS ground_truth FROM qa"""))
def src_case_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one array of a hundred cases each; the id is the release part and the position."""
    rows = fx.qa(spark, sf)
    listed = F.array(*[F.col(f"opt_{c}") for c in "abcd"])
    case_id = F.concat(F.lit("case-"), F.col("doc_id").cast("string"))
    entry = F.struct(
        "doc_id", case_id.alias("Id"), F.col("question").alias("Question"),
        F.when(F.col("closed"), listed).alias("Choice"), F.col("gold").alias("Answer"),
    )
    releases = (
        rows.groupBy(F.floor(F.col("doc_id") / 100).alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("_c"))
        .select("part", F.to_json("_c").alias("value"))
    )
    slide_map = table(spark, sf, "documents").filter(F.col("doc_id") % 3 != 0).select(
        case_id.alias("case_id"),
        F.concat(F.lit("slide_"), F.col("doc_id").cast("string"), F.lit(".svs")).alias("slide_file"),
    )
    path = scratch_path(spark, "cases")
    releases.write.partitionBy("part").text(path)
    elements = arrays.json_elements(spark, path)
    elements = elements.withColumn("part", F.regexp_extract("file", r"/part=([0-9]+)/", 1))
    sid = F.concat_ws(":", F.col("part"), F.col("position").cast("string"))
    made = annotations.case_samples(
        annotations.case_elements(elements, "element", ["part"]), slide_map, sid, "/slides"
    )
    return made.select(
        "sample_id", "image_id", "image_path", F.sha2("question", 256).alias("question_hash"),
        choices_key(F.col("choices")).alias("choices"), "ground_truth",
    )


@query("src_image_index", sql.using("files", body="""
SELECT img AS image_id, path FROM files WHERE path NOT LIKE '%.txt'"""))
def src_image_index(spark: SparkSession, sf: str) -> DataFrame:
    return files.image_index(fx.files(spark, sf))


@query("src_merge_descriptions", """
SELECT slide, patch, arg_max(sha256(text), part) AS text_hash, 'part=' || max(part) AS file FROM (
  SELECT source AS slide, 'p' || (doc_id // 8) AS patch, text, doc_id % 4 AS part FROM documents WHERE doc_id % 29 <> 0
  UNION ALL SELECT source, 'p' || (doc_id // 8), text || '!', (doc_id + 1) % 4 FROM documents WHERE doc_id % 29 <> 0 AND doc_id % 3 = 0)
GROUP BY slide, patch""")
def src_merge_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Four parts with overlaps and unreadable entries, written and read back."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    entry = lambda text: F.to_json(
        F.create_map("source", F.create_map(F.concat(F.lit("p"), F.floor(i / 8).cast("string")), text))
    )
    first = F.struct(entry(F.col("text")).alias("value"), (i % 4).alias("part"))
    again = F.struct(entry(F.concat("text", F.lit("!"))).alias("value"), ((i + 1) % 4).alias("part"))
    both = d.select(i, F.explode(F.when(i % 3 == 0, F.array(first, again)).otherwise(F.array(first))).alias("_e"))
    broken = F.when(i % 29 == 0, F.expr("left(_e.value, length(_e.value) - 2)")).otherwise(F.col("_e.value"))
    path = scratch_path(spark, "descriptions")
    both.select(broken.alias("value"), F.col("_e.part").alias("part")).write.partitionBy("part").text(path)
    texts = spark.read.text(path).select(
        F.concat(F.lit("part="), F.col("part").cast("string")).alias("file"), "value"
    )
    return descriptions.merge_descriptions(texts).select(
        "slide", "patch", F.sha2("text", 256).alias("text_hash"), "file"
    )


@query("src_inventory", """
SELECT 'root/' || source || ', "x"/' || doc_id || '.svs' AS path, doc_id || '.svs' AS basename,
  CASE doc_id % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'symbolic_link' ELSE 'file' END AS type,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 3 THEN '' ELSE n_chars::VARCHAR END AS size FROM documents""")
def src_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged lines with quoted names: folders, links, files and files without a size."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat(F.lit('"root/'), "source", F.lit(', ""x""/'), i.cast("string"), F.lit('.svs"'))
    base = F.concat(i.cast("string"), F.lit(".svs"))
    n = F.col("n_chars").cast("string")
    tail = (
        F.when(i % 4 == 0, F.lit("directory"))
        .when(i % 4 == 1, F.concat(F.lit("symbolic_link,12,file,rwx,t/a.svs, file , "), n, F.lit(",file,7")))
        .when(i % 4 == 2, F.concat(F.lit("file,"), n, F.lit(",2024-01-01,rw")))
        .otherwise(F.lit(" file ,unknown"))
    )
    out = scratch_path(spark, "inventory")
    header = spark.createDataFrame([("path,basename,type,size,mtime",)], "value string")
    d.select(F.concat_ws(",", path, base, tail).alias("value")).unionByName(header).write.text(out)
    return inventory.read_inventory(spark, out)


@query("src_extract_by_key", """
WITH wanted AS (SELECT doc_id, 'img_' || doc_id AS name, 'pre/' || doc_id AS original FROM labels
  UNION SELECT doc_id * 5 + 1, 'img_' || (doc_id * 5 + 1), 'pre/' || (doc_id * 5 + 1) FROM labels)
SELECT doc_id, name, original, CASE WHEN d.text IS NULL THEN 'missing' WHEN here THEN 'already_present' ELSE 'restored' END AS status,
  CASE WHEN d.text IS NOT NULL AND NOT here THEN sha256(d.text) END AS content_sha256
FROM (SELECT *, name IN (SELECT 'img_' || doc_id FROM labels WHERE quality = 1) AS here FROM wanted)
LEFT JOIN documents d USING (doc_id)""")
def src_extract_by_key(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    name = lambda i: F.concat(F.lit("img_"), i.cast("string"))
    row = lambda i: [i.alias("doc_id"), name(i).alias("name"), F.concat(F.lit("pre/"), i.cast("string")).alias("original")]
    wanted = labels.select(*row(F.col("doc_id"))).union(labels.select(*row(F.col("doc_id") * 5 + 1))).distinct()
    present = labels.filter("quality = 1").select(name(F.col("doc_id")).alias("name"))
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return files.extract_by_key(documents, wanted, present, "doc_id", "text")


@query("src_restore_payloads", """
WITH wanted AS (SELECT doc_id, quality = 1 AS here FROM labels
  UNION SELECT doc_id * 5 + 1, false FROM labels WHERE doc_id * 5 + 1 NOT IN (SELECT doc_id FROM labels)),
judged AS (
  SELECT w.doc_id, text, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN w.doc_id % 97 = 5 THEN 'duplicate'
    WHEN here THEN 'already_present' WHEN w.doc_id % 89 = 7 OR coalesce(text, '') = '' THEN 'empty' ELSE 'restored' END AS status
  FROM wanted w LEFT JOIN documents d USING (doc_id))
SELECT doc_id || '.jpg' AS key, 'img_' || doc_id AS name, 'pre/x/' || doc_id || '.jpg' AS original, status,
  CASE status WHEN 'restored' THEN sha256(text) END AS sha256, CASE status WHEN 'restored' THEN strlen(text) END::BIGINT AS size,
  CASE status WHEN 'restored' THEN text END AS payload FROM judged""")
def src_restore_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as images in a table with nested names: some twice, some empty, some not there."""
    i = F.col("doc_id")
    times = F.when(i % 97 == 5, 2).otherwise(1)
    image = F.struct(
        F.concat(F.lit("a/b/"), i.cast("string"), F.lit(".jpg")).alias("path"),
        F.when(i % 89 != 7, F.col("text")).cast("binary").alias("bytes"),
    )
    path, store = scratch_path(spark, "images"), scratch_path(spark, "store")
    table(spark, sf, "documents").select(image.alias("image"), F.explode(F.sequence(F.lit(1), times))).write.parquet(path)
    labels = table(spark, sf, "labels")
    ids = labels.select("doc_id").union(labels.select(i * 5 + 1)).distinct()
    name = F.concat(F.lit("img_"), i.cast("string")).alias("name")
    rows = ids.select(name, F.concat(F.lit("pre/x/"), i.cast("string"), F.lit(".jpg")).alias("original"))
    mapping = payloads.mapping_of(rows, "name", "original", "pre")
    present = labels.filter("quality = 1").select(name)
    report = payloads.restore_payloads(
        spark, [path], mapping, store, present, "image.path", as_base_name=True, strict=False
    )
    kept = payloads.stored(spark, store).select("key", F.col("content").cast("string").alias("payload"))
    return report.join(kept, "key", "left")


@query("src_results", sql.using("qa", "predictions", body="""
SELECT run, count(*) AS results, count(*) FILTER (WHERE status = 'ok') AS ok, 0 AS repeated,
  max(sha256(pred_answer)) AS last_answer, any_value(bad) AS mismatched
FROM (SELECT *, 'shard_' || shard AS run, CASE WHEN shard IN (5, 7) THEN count(*) OVER (PARTITION BY shard) ELSE 0 END AS bad
      FROM predictions) GROUP BY run"""))
def src_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results of 16 runs, read back and tied to their locks: one run has foreign hashes, one
    no lock."""
    root = scratch_path(spark, "runs")
    rows = fx.predictions(spark, sf)
    shard = F.col("shard").cast("string")
    lock = F.when(F.col("shard") == 5, "other").otherwise(F.concat(F.lit("hash_"), shard))
    written = rows.select(
        "sample_id", "status", "pred_answer", lock.alias("run_hash"),
        F.concat(F.lit("shard_"), shard).alias("run"),
    )
    results.write_run_results(written, root)
    read = results.read_results(spark, root)
    repeated = find_duplicates(read, ["sample_id"]).agg(F.count("*").alias("repeated"))
    identity = check_identity(read, run_locks(spark, sf)).select("run", "mismatched")
    return (
        read.groupBy("run")
        .agg(
            F.count("*").alias("results"), F.count_if(F.col("status") == "ok").alias("ok"),
            F.max(F.sha2("pred_answer", 256)).alias("last_answer"),
        )
        .join(identity, "run")
        .crossJoin(F.broadcast(repeated))
    )


def _row_json() -> str:
    parts = ["'{\"A\": ' || " + sql.js("opt_a")]
    parts += [f"', \"{c.upper()}\": ' || " + sql.js(f"opt_{c}") for c in "bcd"]
    options = "CASE WHEN closed THEN " + " || ".join(parts) + " || '}' ELSE '{}' END"
    return (
        "'{\"choices\": ' || " + options + " || ', \"ground_truth\": ' || " + sql.js("gold")
        + " || ', \"question\": ' || " + sql.js("question") + " || ', \"sample_id\": ' || "
        + sql.js("sample_id") + " || '}'"
    )


def _digest_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf)
    return rows.select(
        "sample_id", "question", fx.options(rows).alias("choices"), F.col("gold").alias("ground_truth")
    )


@query("manifest_digest", sql.using("qa", f"""d AS (SELECT sha256({_row_json()}) AS h FROM qa),
l1 AS (SELECT substr(h, 1, 5) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM d GROUP BY 1),
l2 AS (SELECT substr(p, 1, 2) AS q, sum(n) AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l1 GROUP BY 1)""", body="""
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY q)) AS digest FROM l2"""))
def manifest_digest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.manifest_digest(_digest_rows(spark, sf))


@query("src_manifest", sql.using("qa", body="""
SELECT sample_id, sha256(question) AS question_hash, gold AS ground_truth FROM qa"""))
def src_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Written, verified and read back."""
    path = scratch_path(spark, "manifest")
    manifest.write_manifest(_digest_rows(spark, sf), path, purpose="full")
    return manifest.read_manifest(spark, path).select(
        "sample_id", F.sha2("question", 256).alias("question_hash"), "ground_truth"
    )


_SHARD_TREE = """d AS (SELECT doc_id % 7 AS shard, sha256({row}) AS h FROM qa),
l1 AS (SELECT shard, substr(h, 1, 5) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM d GROUP BY ALL),
l2 AS (SELECT shard, substr(p, 1, 2) AS q, sum(n) AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l1 GROUP BY ALL),
roots AS (SELECT shard, sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY q)) AS digest FROM l2 GROUP BY shard),
p1 AS (SELECT substr(h, 1, 5) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM d GROUP BY 1),
p2 AS (SELECT substr(p, 1, 2) AS q, sha256(string_agg(h, '' ORDER BY p)) AS h FROM p1 GROUP BY 1),
parent AS (SELECT sha256(string_agg(h, '' ORDER BY q)) AS parent_digest FROM p2),
total AS (SELECT count(*) AS shard_count, sha256(string_agg(digest, '' ORDER BY shard)) AS combined FROM roots)"""


@query("src_shard_manifests", sql.using("qa", _SHARD_TREE.format(row=_row_json()), body="""
SELECT shard, shard_count, rows, digest, parent_digest, combined FROM roots, parent, total"""))
def src_shard_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Seven shards of a written manifest, each tied to it by its header."""
    parent, path = scratch_path(spark, "manifest"), scratch_path(spark, "shards")
    rows = _digest_rows(spark, sf)
    manifest.write_manifest(rows, parent, purpose="full")
    number = F.regexp_extract("sample_id", "[0-9]+$", 0).cast("bigint")
    return manifest.write_shard_manifests(rows.withColumn("shard", number % 7), path, parent)


@query("src_hash_files", """
SELECT 'f/' || doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN strlen(text)::BIGINT END AS size,
  CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS md5,
  CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'unexpected' WHEN doc_id % 11 = 3 OR doc_id % 13 = 4 THEN 'mismatch' ELSE 'ok' END AS status
FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 1)""")
def src_hash_files(spark: SparkSession, sf: str) -> DataFrame:
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    path = F.concat(F.lit("f/"), i.cast("string")).alias("path")
    content = F.col("text").cast("binary")
    found = d.filter(i % 7 != 0).select(path, content.alias("content"), F.octet_length("text").alias("size"))
    wanted = d.filter(i % 5 != 1).select(
        path,
        F.when(i % 11 == 3, F.lit("0")).otherwise(F.sha2(content, 256)).alias("want_sha256"),
        (F.octet_length("text") + F.when(i % 13 == 4, 1).otherwise(0)).alias("want_size"),
    )
    return files.hash_files(found, wanted)
