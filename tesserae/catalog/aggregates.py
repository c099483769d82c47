"""Registered queries: scores, text metrics, costs and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.operators import profiles, samples, scoring, sharding, textmetrics
from tesserae.runtime import table

_GROUPS = """CASE task WHEN 'fr' THEN 'ER' WHEN 'de' THEN 'PR' ELSE task END"""


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest with two tasks renamed to members of a published group."""
    task = F.when(F.col("task") == "fr", "ER").when(F.col("task") == "de", "PR").otherwise(F.col("task"))
    return fx.manifest(spark, sf).withColumn("task", task)


@query("agg_score_closed", sql.using("qa", "predictions", "judged", body=f"""
SELECT grp AS "group", count(*) FILTER (WHERE correct) AS correct, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy_percent
FROM (SELECT correct, unnest(['closed_overall', 'source:' || source, 'task:' || t,
        'paper_group:' || CASE WHEN t IN ('ER', 'PR', 'HER2') THEN 'Receptor' ELSE t END]) AS grp
      FROM (SELECT *, {_GROUPS} AS t FROM judged)) GROUP BY grp"""))
def agg_score_closed(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_closed(_manifest(spark, sf), fx.predictions(spark, sf))
    return scored.withColumn("accuracy_percent", F.round("accuracy_percent", 6))


@query("agg_counters", sql.using("qa", "predictions", "judged", body="""
SELECT count(*) AS expected, count(*) FILTER (WHERE NOT missing) AS received, count(*) FILTER (WHERE missing) AS missing,
  count(*) FILTER (WHERE NOT missing AND NOT valid) AS invalid, count(*) FILTER (WHERE missing) = 0 AS complete
FROM judged_p"""))
def agg_counters(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_counters(fx.manifest(spark, sf), fx.predictions(spark, sf))


@query("agg_open_exact", sql.using("qa", "predictions", "judged", body=f"""
SELECT count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (WHERE pred_answer <> ''
  AND {sql.norm('gold')} = {sql.norm('pred_answer')}) / count(*), 6) AS exact_match_percent
FROM judged_p WHERE NOT closed"""))
def agg_open_exact(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_open(fx.manifest(spark, sf), fx.predictions(spark, sf))
    return scored.select("total", F.round("exact_match_percent", 6).alias("exact_match_percent"))


@query("agg_summarize", sql.using("qa", body="""
SELECT CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS kind,
  coalesce(task, source, '') AS name, count(*) AS questions, count(DISTINCT image_id) AS images
FROM qa GROUP BY GROUPING SETS ((), (task), (source))"""))
def agg_summarize(spark: SparkSession, sf: str) -> DataFrame:
    return samples.summarize(fx.qa(spark, sf).select("image_id", "task", "source"))


@query("agg_confusion", sql.using("qa", "predictions", "judged", body=f"""
SELECT task, {sql.text_of('gold')} AS truth, coalesce({sql.text_of('predicted')}, '') AS predicted, count(*) AS questions
FROM judged GROUP BY ALL"""))
def agg_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.confusion(fx.manifest(spark, sf), fx.predictions(spark, sf))


@query("agg_recall", sql.using("qa", "predictions", "judged", body="""
SELECT task, gold_text AS truth, count(*) FILTER (WHERE correct) AS hits, count(*) AS support,
  round(100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*), 6) AS recall_percent
FROM judged GROUP BY task, gold_text"""))
def agg_recall(spark: SparkSession, sf: str) -> DataFrame:
    recall = scoring.class_recall(agg_confusion(spark, sf))
    return recall.withColumn("recall_percent", F.round("recall_percent", 6))


@query("agg_balanced_accuracy", sql.using("qa", "predictions", "judged", body="""
SELECT task, count(*) AS classes, round(avg(r), 6) AS balanced_accuracy_percent FROM (
  SELECT task, gold_text, 100.0::DOUBLE * count(*) FILTER (WHERE correct) / count(*) AS r
  FROM judged GROUP BY task, gold_text) GROUP BY task"""))
def agg_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    table_ = scoring.balanced_accuracy(agg_confusion(spark, sf))
    return table_.withColumn("balanced_accuracy_percent", F.round("balanced_accuracy_percent", 6))


@query("agg_compare_runs", sql.using("qa", "predictions", "second", "judged", sql.judged("judged2", "second"), body="""
SELECT a.task, count(*) FILTER (WHERE NOT a.correct AND b.correct) AS fixed,
  count(*) FILTER (WHERE a.correct AND NOT b.correct) AS broken,
  count(*) FILTER (WHERE a.correct AND b.correct) AS both_right,
  count(*) FILTER (WHERE NOT a.correct AND NOT b.correct) AS both_wrong
FROM judged a JOIN judged2 b USING (sample_id) GROUP BY a.task"""))
def agg_compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.compare_runs(
        fx.manifest(spark, sf), fx.predictions(spark, sf), fx.predictions(spark, sf, 5, 1)
    )


_VERDICT = "CASE WHEN {0}.correct THEN 'right' WHEN {0}.predicted IS NULL THEN 'none' ELSE 'wrong' END"


@query("agg_transitions", sql.using("qa", "predictions", "second", "judged", sql.judged("judged2", "second"), body=f"""
SELECT {_VERDICT.format('a')} AS from_state, {_VERDICT.format('b')} AS to_state, count(*) AS questions
FROM judged a JOIN judged2 b USING (sample_id) GROUP BY 1, 2"""))
def agg_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.transitions(
        fx.manifest(spark, sf), fx.predictions(spark, sf), fx.predictions(spark, sf, 5, 1)
    )


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

_GRAMS = f"""words AS (SELECT row_id, {_WORDS.format('ref')} AS r, {_WORDS.format('hyp')} AS h FROM pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
rg AS (SELECT row_id, n, list_aggregate(r[i:i + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT row_id, n, r, unnest(range(1, greatest(len(r) - n + 2, 1))) AS i FROM words, ns)),
hg AS (SELECT row_id, n, list_aggregate(h[i:i + n - 1], 'string_agg', ' ') AS gram
  FROM (SELECT row_id, n, h, unnest(range(1, greatest(len(h) - n + 2, 1))) AS i FROM words, ns)),
counts AS (SELECT row_id, n, gram, sum(a) AS in_ref, sum(b) AS in_hyp FROM (
  SELECT row_id, n, gram, 1 AS a, 0 AS b FROM rg UNION ALL SELECT row_id, n, gram, 0, 1 FROM hg)
  GROUP BY row_id, n, gram)"""


@query("agg_bleu", sql.using("pairs", _GRAMS, body="""
, stat AS (SELECT n, sum(least(in_ref, in_hyp))::DOUBLE AS m FROM counts GROUP BY n),
lens AS (SELECT sum(len(r))::DOUBLE AS rl, sum(len(h))::DOUBLE AS hl FROM words),
guess AS (SELECT n, sum(greatest(len(h) - n + 1, 0))::DOUBLE AS g FROM words, ns GROUP BY n),
p AS (SELECT n, (m + 1e-15) / (g + 1e-9) AS p FROM stat JOIN guess USING (n)),
bp AS (SELECT CASE WHEN (hl + 1e-15) / (rl + 1e-9) < 1 THEN exp(1 - (rl + 1e-9) / (hl + 1e-15)) ELSE 1.0 END AS b FROM lens)
SELECT round((SELECT product(p) FROM p WHERE n <= 1) * b, 6) AS bleu_1,
  round(pow((SELECT product(p) FROM p WHERE n <= 2), 1 / 2.0::DOUBLE) * b, 6) AS bleu_2,
  round(pow((SELECT product(p) FROM p WHERE n <= 3), 1 / 3.0::DOUBLE) * b, 6) AS bleu_3,
  round(pow((SELECT product(p) FROM p WHERE n <= 4), 1 / 4.0::DOUBLE) * b, 6) AS bleu_4
FROM bp"""))
def agg_bleu(spark: SparkSession, sf: str) -> DataFrame:
    scores = textmetrics.bleu(fx.pairs(spark, sf))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


# The longest common subsequence, one word of the reference at a time: ``line`` holds the
# best length up to each word of the other text. A new line is the running maximum of what
# the old one offers.
_ROUGE_SQL = f"""words AS (SELECT row_id, {_WORDS.format('ref')} AS r, {_WORDS.format('hyp')} AS h FROM pairs),
lines(row_id, i, line) AS (
  SELECT row_id, 0, list_transform(h, lambda w: 0) FROM words
  UNION ALL
  SELECT row_id, i, list_transform(range(1, len(offer) + 1), lambda j: list_max(offer[1:j])) FROM (
    SELECT l.row_id, l.i + 1 AS i, list_transform(range(1, len(w.h) + 1), lambda j: greatest(l.line[j],
      CASE WHEN j > 1 THEN l.line[j - 1] ELSE 0 END + (w.h[j] = w.r[l.i + 1])::INT)) AS offer
    FROM lines l JOIN words w USING (row_id) WHERE l.i < len(w.r))),
lcs AS (SELECT w.row_id, len(r)::DOUBLE AS nr, len(h)::DOUBLE AS nh, coalesce(line[len(h)], 0)::DOUBLE AS n
  FROM words w JOIN lines l ON l.row_id = w.row_id AND l.i = len(w.r))"""


@query("agg_rouge_l", sql.using("pairs", _ROUGE_SQL, recursive=True, body=f"""
SELECT count(*) AS rows, round(avg(CASE WHEN n > 0 THEN
  (1 + {textmetrics.ROUGE_BETA}::DOUBLE * {textmetrics.ROUGE_BETA}) * (n / nh) * (n / nr)
  / (n / nr + {textmetrics.ROUGE_BETA}::DOUBLE * {textmetrics.ROUGE_BETA} * (n / nh)) ELSE 0 END), 6) AS rouge_l FROM lcs"""))
def agg_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    scores = textmetrics.rouge_l(fx.pairs(spark, sf))
    return scores.select("rows", F.round("rouge_l", 6).alias("rouge_l"))


@query("agg_cider", sql.using("pairs", _GRAMS, body="""
, docs AS (SELECT count(*)::DOUBLE AS d FROM words),
df AS (SELECT n, gram, count(*) AS f FROM counts WHERE in_ref > 0 GROUP BY n, gram),
w AS (SELECT row_id, n, in_ref * idf AS wr, in_hyp * idf AS wh FROM (
  SELECT c.*, ln(d) - ln(greatest(1.0::DOUBLE, coalesce(f, 0))) AS idf FROM counts c LEFT JOIN df USING (n, gram), docs)),
per AS (SELECT row_id, n, sum(least(wh, wr) * wr) AS dot, sqrt(sum(wr * wr)) AS nr, sqrt(sum(wh * wh)) AS nh
  FROM w GROUP BY row_id, n)
SELECT (SELECT count(*) FROM words) AS rows, round(sum(CASE WHEN nr <> 0 AND nh <> 0 THEN dot / (nr * nh) ELSE dot END
    * exp(-pow(greatest(len(h) - 1, 0) - greatest(len(r) - 1, 0), 2) / 72.0::DOUBLE))
  / 4 / (SELECT count(*) FROM words) * 10, 6) AS cider
FROM per JOIN words USING (row_id)"""))
def agg_cider(spark: SparkSession, sf: str) -> DataFrame:
    scores = textmetrics.cider(fx.pairs(spark, sf))
    return scores.select("rows", F.round("cider", 6).alias("cider"))


_TILES = """CASE WHEN input_kind = 'roi' THEN 1 ELSE (ceil(width / 4096) * ceil(height / 4096))::BIGINT END"""


@query("agg_image_costs", sql.using("image_rows", "order_images", "model_calls", f"""counts AS (
  SELECT image_id, count(*) AS q FROM image_rows GROUP BY image_id),
facts AS (SELECT image_id, q, {_TILES} AS r FROM counts JOIN order_images USING (image_id)),
unit AS (SELECT greatest(1.0::DOUBLE, s - l) / u AS per FROM
  (SELECT sum(r + 5 * q) AS u FROM facts),
  (SELECT sum(seconds) AS s, sum(CASE WHEN stage = 'error' THEN seconds END) AS l FROM model_calls))""", body="""
SELECT image_id, q + 1.0::DOUBLE AS by_questions, r * 20.0::DOUBLE + q * 120 AS by_grid_first,
  r * 30.0::DOUBLE + q * 180 AS by_grid_later, round(per * (r + 5 * q), 6) AS by_profile
FROM facts, unit"""))
def agg_image_costs(spark: SparkSession, sf: str) -> DataFrame:
    rows, images = fx.image_rows(spark, sf), fx.order_images(spark, sf)
    measured = sharding.question_counts(rows).join(sharding.region_counts(images), "image_id")
    load = F.sum(F.when(F.col("stage") == "error", F.col("seconds"))).alias("model_load_seconds")
    seconds = fx.model_calls(spark, sf).agg(F.sum("seconds").alias("seconds"), load)
    named = {
        "by_questions": sharding.costs_by_questions(rows),
        "by_grid_first": sharding.costs_by_grid(rows, images, *sharding.COST_PRIORS["first"]),
        "by_grid_later": sharding.costs_by_grid(rows, images, *sharding.COST_PRIORS["later"]),
        "by_profile": sharding.costs_by_profile(rows, images, measured, seconds),
    }
    out = None
    for name, costs in named.items():
        one = costs.select("image_id", F.round("cost", 6).alias(name))
        out = one if out is None else out.join(one, "image_id")
    return out


@query("agg_cost_history", """
SELECT lpad(o_custkey::VARCHAR, 12, '0') AS image_id, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY o_custkey""")
def agg_cost_history(spark: SparkSession, sf: str) -> DataFrame:
    history = table(spark, sf, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("image_id"),
        F.col("o_totalprice").alias("seconds"),
    )
    return sharding.costs_by_history(history).select("image_id", F.round("cost", 2).alias("cost"))


@query("agg_profile", sql.using("model_calls", body="""
SELECT stage, case_id, count(*) AS calls, round(sum(seconds), 4) AS seconds, sum(output_tokens)::BIGINT AS output_tokens,
  sum(input_tokens)::BIGINT AS input_tokens, round(avg(seconds), 6) AS mean_seconds,
  count(*) FILTER (WHERE output_tokens >= 90) AS cap_hits, (grouping(stage) * 2 + grouping(case_id))::BIGINT AS level
FROM model_calls GROUP BY ROLLUP (stage, case_id)"""))
def agg_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = profiles.profile_calls(fx.model_calls(spark, sf), cap=90)
    return profile.withColumns(
        {"seconds": F.round("seconds", 4), "mean_seconds": F.round("mean_seconds", 6)}
    )


@query("agg_image_profile", sql.using("image_rows", "order_images", body="""
SELECT i.image_id, round(coalesce(sum(s), 0), 2) AS seconds, coalesce(any_value(n), 0) AS regions, count(*) AS questions
FROM image_rows i
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey) c ON c.l_orderkey = i.order_id
LEFT JOIN (SELECT lpad(l_suppkey::VARCHAR, 12, '0') AS image_id, count(*) AS n FROM lineitem GROUP BY l_suppkey) r
  ON r.image_id = i.image_id
GROUP BY i.image_id"""))
def agg_image_profile(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    calls = lines.select(
        F.concat(F.lit("ord:"), F.col("l_orderkey").cast("string")).alias("sample_id"),
        F.col("l_quantity").alias("seconds"),
    )
    tiles = lines.select(F.lpad(F.col("l_suppkey").cast("string"), 12, "0").alias("image_id"))
    profile = profiles.image_profile(calls, fx.image_rows(spark, sf), tiles)
    return profile.withColumn("seconds", F.round("seconds", 2))


@query("agg_cohorts", sql.using("qa", body="""
SELECT coalesce(f.cohort, k.cohort) AS cohort, coalesce(slides, 0) AS slides, k.cohort IS NOT NULL AS known,
  k.cohort IS NOT NULL AND coalesce(slides, 0) = (SELECT count(*) // 20 FROM documents) AS ok
FROM (SELECT source AS cohort, count(DISTINCT doc_id - doc_id % 2) AS slides FROM qa WHERE source <> 'src7' GROUP BY source) f
FULL JOIN (SELECT DISTINCT source AS cohort FROM documents WHERE source <> 'src3') k ON f.cohort = k.cohort"""))
def agg_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    members = fx.qa(spark, sf).filter("source <> 'src7'").select(
        F.col("source").alias("cohort"), (F.col("doc_id") - F.col("doc_id") % 2).alias("slide_id")
    )
    known = d.filter("source <> 'src3'").select(F.col("source").alias("cohort"))
    size = d.agg(F.floor(F.count("*") / 20).cast("bigint").alias("_k"))
    checked = profiles.check_cohorts(members, known, -1).drop("ok").crossJoin(size)
    return checked.select(
        "cohort", "slides", "known", (F.col("known") & (F.col("slides") == F.col("_k"))).alias("ok")
    )


@query("agg_plan_totals", sql.using("files", body="""
SELECT lang AS cohort, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) / 1073741824.0::DOUBLE, 3) AS gib
FROM files JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)"""))
def agg_plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    cohort = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cohort"))
    listed = fx.files(spark, sf).join(cohort, "doc_id").withColumnRenamed("size", "size_bytes")
    return profiles.plan_totals(listed)
