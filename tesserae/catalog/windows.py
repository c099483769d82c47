"""Registered queries: retrieval, sampling, ranking, sharding and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.operators import profiles, ranking, sampling, sharding
from tesserae.operators.retrieval import retrieve
from tesserae.runtime import table

SAMPLE_SIZE = 100
SEED = 128


@query("win_retrieve", sql.using("regions", """n AS (
  SELECT image_id, count(*) AS n FROM regions GROUP BY image_id),
scored AS (SELECT q.vec_id AS query_id, r.region_id, n,
    round(list_dot_product(q.vector, r.vector) / sqrt(list_dot_product(q.vector, q.vector))
      / sqrt(list_dot_product(r.vector, r.vector)), 9) AS score
  FROM regions q JOIN regions r USING (image_id) JOIN n USING (image_id))""", body="""
SELECT query_id, region_id, round(score, 6) AS score, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, region_id) AS rk FROM scored)
WHERE rk <= ceil(n * 0.10::DOUBLE)"""))
def win_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.regions(spark, sf)
    sizes = r.groupBy("image_id").agg(F.count("*").alias("_n"))
    queries = r.select(F.col("vec_id").alias("query_id"), "image_id", "vector").join(sizes, "image_id")
    asked = queries.withColumn("k", F.ceil(F.col("_n") * F.lit(0.10)))
    found = retrieve(asked.drop("_n"), r.select("image_id", "region_id", "vector"))
    return found.select("query_id", "region_id", F.round("score", 6).alias("score"), "rk")


_QUOTAS = f"""strata AS (SELECT task, answer_text, count(*) AS g, (SELECT count(*) FROM image_rows) AS n,
    greatest(1, {SAMPLE_SIZE} * count(*) // (SELECT count(*) FROM image_rows))::BIGINT AS q
  FROM image_rows GROUP BY task, answer_text),
tot AS (SELECT sum(q) AS s FROM strata),
up AS (SELECT task, answer_text, 1 AS d FROM (
  SELECT task, answer_text, row_number() OVER (ORDER BY {SAMPLE_SIZE} * g - q * n DESC, task DESC, answer_text DESC) AS r
  FROM strata WHERE q < g), tot WHERE r <= {SAMPLE_SIZE} - s),
down AS (SELECT task, answer_text, count(*) AS d FROM (
  SELECT task, answer_text, row_number() OVER (ORDER BY q * n - {SAMPLE_SIZE} * g - j * n DESC, task DESC, answer_text DESC) AS r
  FROM (SELECT *, unnest(range(0, q - 1)) AS j FROM strata)), tot WHERE r <= s - {SAMPLE_SIZE} GROUP BY task, answer_text),
quotas AS (SELECT task, answer_text, g AS source_count,
    (q + coalesce(up.d, 0) - coalesce(down.d, 0))::BIGINT AS sample_count
  FROM strata LEFT JOIN up USING (task, answer_text) LEFT JOIN down USING (task, answer_text))"""


@query("win_stratified_sample", sql.using("image_rows", _QUOTAS, body=f"""
SELECT order_id, task, answer_text FROM (
  SELECT *, row_number() OVER (PARTITION BY task, answer_text ORDER BY
    sha256('[{SEED}, "' || order_id || '"]'), order_id::VARCHAR) AS r FROM image_rows) JOIN quotas USING (task, answer_text)
WHERE r <= sample_count"""))
def win_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.image_rows(spark, sf).select("order_id", "task", "answer_text")
    sample, _ = sampling.stratified_sample(rows, ["task", "answer_text"], "order_id", SAMPLE_SIZE, SEED)
    return sample


@query("win_strata", sql.using("image_rows", _QUOTAS, body="SELECT * FROM quotas"))
def win_strata(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.strata_quotas(fx.image_rows(spark, sf), ["task", "answer_text"], SAMPLE_SIZE)


_DIGEST = "sha256('\"' || sample_id || '\"')"


@query("win_smoke_a", sql.using("qa", body=f"""
SELECT sample_id, source FROM (SELECT sample_id, source,
  row_number() OVER (PARTITION BY source ORDER BY {_DIGEST}) AS r FROM qa) WHERE r <= 2"""))
def win_smoke_a(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.smoke_by_source(fx.qa(spark, sf).select("sample_id", "source"))


@query("win_smoke_b", sql.using("image_rows", "order_images", body="""
SELECT sample_id, image_id FROM image_rows WHERE image_id IN (
  SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY width * height, image_id) - 1 AS place,
      count(*) OVER () AS n FROM order_images WHERE image_id IN (SELECT image_id FROM image_rows))
  WHERE place IN (0, n // 2, n - 1))"""))
def win_smoke_b(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.image_rows(spark, sf).select("sample_id", "image_id")
    return sampling.smoke_by_area(rows, fx.order_images(spark, sf)).select("sample_id", "image_id")


@query("win_smoke_c", sql.using("image_rows", body=f"""
SELECT sample_id, image_id, closed FROM (SELECT sample_id, image_id, closed,
    row_number() OVER (PARTITION BY image_id, closed ORDER BY {_DIGEST}) AS r FROM image_rows
  WHERE image_id IN (SELECT image_id FROM image_rows GROUP BY image_id
    HAVING count(*) FILTER (WHERE closed) >= 2 AND count(*) FILTER (WHERE NOT closed) >= 2 ORDER BY image_id LIMIT 2))
WHERE r <= 2"""))
def win_smoke_c(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.smoke_mixed(fx.image_rows(spark, sf).select("sample_id", "image_id", "closed"))


@query("win_smoke_d", sql.using("image_rows", "order_images", f"""owner AS (
  SELECT image_id, min(source) AS source FROM image_rows GROUP BY image_id),
base AS (SELECT sample_id, image_id, source, task FROM image_rows WHERE task <> '5-LOW' AND image_id IN (
  SELECT image_id FROM (SELECT image_id, row_number() OVER (PARTITION BY source ORDER BY width * height, image_id) - 1 AS place,
      count(*) OVER (PARTITION BY source) AS n FROM order_images JOIN owner USING (image_id))
  WHERE place IN (0, n // 2, n - 1)))""", body=f"""
SELECT * FROM base UNION ALL
SELECT sample_id, image_id, source, task FROM (SELECT sample_id, image_id, source, task,
  row_number() OVER (PARTITION BY task ORDER BY {_DIGEST}) AS r FROM image_rows
  WHERE task NOT IN (SELECT task FROM base)) WHERE r = 1"""))
def win_smoke_d(spark: SparkSession, sf: str) -> DataFrame:
    """One task is kept away from the chosen images, so that it needs its own row."""
    rows = fx.image_rows(spark, sf).select("sample_id", "image_id", "source", "task")
    images = fx.order_images(spark, sf)
    hidden = F.col("task") == "5-LOW"
    moved = rows.withColumn("image_id", F.when(hidden, F.concat(F.lit("none_"), "sample_id")).otherwise(F.col("image_id")))
    keep = rows.select(F.col("sample_id"), F.col("image_id").alias("_image"))
    # Every image keeps at least its original owner row for the size ranking.
    anchors = rows.filter(hidden).withColumns({
        "sample_id": F.concat(F.lit("anchor:"), "sample_id"), "task": F.lit("anchor"),
    })
    chosen = sampling.smoke_covering(moved.unionByName(anchors), images)
    return chosen.join(keep, "sample_id").select("sample_id", F.col("_image").alias("image_id"), "source", "task")


@query("win_pick_smallest", sql.using("files", """cand AS (
  SELECT 'case_' || lpad((doc_id % 37)::VARCHAR, 4, '0') AS case_id, path AS name, size, doc_id % 5 <> 2 AS eligible
  FROM files),
best AS (SELECT case_id, name, size FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY size, name) AS r
    FROM cand WHERE eligible) WHERE r = 1 ORDER BY size, name LIMIT 2),
lim AS (SELECT size, name FROM best ORDER BY size DESC, name DESC LIMIT 1)""", body="""
SELECT case_id, name, size, 'selected' AS status FROM best
UNION ALL SELECT c.case_id, c.name, c.size, 'rejected' FROM cand c LEFT JOIN best b USING (case_id), lim
WHERE NOT c.eligible AND (c.size, c.name) < (lim.size, lim.name)
  AND (b.name IS NULL OR (c.size, c.name) < (b.size, b.name))"""))
def win_pick_smallest(spark: SparkSession, sf: str) -> DataFrame:
    case = F.concat(F.lit("case_"), F.lpad((F.col("doc_id") % 37).cast("string"), 4, "0"))
    listed = fx.files(spark, sf).select(
        case.alias("case_id"), F.col("path").alias("name"), "size",
        (F.col("doc_id") % 5 != 2).alias("eligible"),
    )
    best, skipped = sampling.pick_smallest(listed, "case_id", F.col("eligible"), 2)
    return best.drop("eligible").withColumn("status", F.lit("selected")).unionByName(
        skipped.drop("eligible").withColumn("status", F.lit("rejected"))
    )


@query("win_call_seeds", sql.using("model_calls", body=f"""
SELECT event_id, i AS call_index, ('0x' || substr(sha256('[{SEED}, "' || case_id || '", "' || stage || ':' || i || '"]'), 1, 8))::BIGINT AS seed
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, stage ORDER BY ts, event_id) - 1 AS i FROM model_calls)"""))
def win_call_seeds(spark: SparkSession, sf: str) -> DataFrame:
    calls = fx.model_calls(spark, sf).select("event_id", "ts", "case_id", "stage")
    order = [F.col("ts"), F.col("event_id")]
    return profiles.call_seeds(calls, order, SEED).select("event_id", "call_index", "seed")


@query("win_split", """
SELECT name, (row_number() OVER (ORDER BY name) - 1) // ((count(*) OVER () + 6) // 7) + 1 AS part
FROM (SELECT DISTINCT source || '/' || doc_id AS name FROM documents)""")
def win_split(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name")
    )
    return ranking.split_contiguous(names, "name", 7)


@query("win_shards", sql.using("image_rows", """costs AS (
  SELECT image_id, 1 + count(*)::BIGINT AS cost, count(*) AS questions,
    row_number() OVER (ORDER BY count(*) DESC, image_id) AS rn FROM image_rows GROUP BY image_id),
walk(rn, totals, shard) AS (
  SELECT 0::BIGINT, list_transform(range(16), lambda x: 0::BIGINT), 0::BIGINT
  UNION ALL
  SELECT c.rn, list_transform(w.totals, lambda t, i: t + CASE WHEN i = list_position(w.totals, list_min(w.totals)) THEN c.cost ELSE 0 END),
    (list_position(w.totals, list_min(w.totals)) - 1)::BIGINT
  FROM walk w JOIN costs c ON c.rn = w.rn + 1)""", body="""
SELECT image_id, cost::DOUBLE AS cost, shard FROM costs JOIN walk USING (rn)""", recursive=True))
def win_shards(spark: SparkSession, sf: str) -> DataFrame:
    costs = sharding.costs_by_questions(fx.image_rows(spark, sf))
    return sharding.assign_shards(costs, 16).withColumn("shard", F.col("shard").cast("bigint"))


@query("win_shard_totals", sql.using("image_rows", """costs AS (
  SELECT image_id, 1 + count(*)::BIGINT AS cost, count(*) AS questions,
    row_number() OVER (ORDER BY count(*) DESC, image_id) AS rn FROM image_rows GROUP BY image_id),
walk(rn, totals, shard) AS (
  SELECT 0::BIGINT, list_transform(range(16), lambda x: 0::BIGINT), 0::BIGINT
  UNION ALL
  SELECT c.rn, list_transform(w.totals, lambda t, i: t + CASE WHEN i = list_position(w.totals, list_min(w.totals)) THEN c.cost ELSE 0 END),
    (list_position(w.totals, list_min(w.totals)) - 1)::BIGINT
  FROM walk w JOIN costs c ON c.rn = w.rn + 1)""", body="""
SELECT shard, count(*) AS images, sum(questions)::BIGINT AS questions, sum(cost)::DOUBLE AS cost
FROM costs JOIN walk USING (rn) GROUP BY shard""", recursive=True))
def win_shard_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.image_rows(spark, sf)
    assigned = sharding.assign_shards(sharding.costs_by_questions(rows), 16)
    totals = sharding.shard_totals(assigned, rows)
    return totals.withColumn("shard", F.col("shard").cast("bigint"))


@query("win_chunk", """
SELECT source, block, count(*) AS n_rows, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_hash
FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS block FROM documents)
GROUP BY source, block""")
def win_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", "text")
    chunks = ranking.chunk_rows(rows, ["source"], [F.col("doc_id")], 10)
    joined = ranking.join_blocks(chunks, ["source"], "text")
    return joined.select("source", "block", "n_rows", F.sha2("text", 256).alias("text_hash"))
