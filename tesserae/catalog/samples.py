"""Registered queries: projections, scalar functions and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.functions import geometry as geo
from tesserae.functions import prompts
from tesserae.functions.choices import (
    answer_label,
    choices_from_columns,
    choices_key,
    normalize_choices,
    same_answer,
)
from tesserae.functions.digest import digest_list, sample_seed, unique_id
from tesserae.functions.responses import strip_think
from tesserae.functions.text import json_string, normalize_text
from tesserae.functions.vectors import norm
from tesserae.operators import samples as ops
from tesserae.operators.conversations import STYLES, Style, render_styles
from tesserae.operators.joins import resolve_images
from tesserae.operators.regions import scale_columns
from tesserae.operators.responses import validate_responses
from tesserae.operators.retrieval import unit_rows
from tesserae.runtime import table
from tesserae.sources.files import extract_links, indexed_links, pick_indexed, pick_links

# ---------------------------------------------------------------- projections


def _raw_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf)
    choices = choices_from_columns(*[(c.upper(), F.col(f"opt_{c}")) for c in "abcd"])
    return rows.select(
        F.col("doc_id").alias("sid"), "doc_id", "image_id", "question", choices.alias("choices"),
        F.col("gold").alias("answer"), "split", "task", "source", "img",
    )


@query("prj_make_samples", sql.using("qa", body=f"""
SELECT 'demo:' || doc_id AS sample_id, split, image_id, sha256(question) AS question_hash,
  CASE WHEN closed THEN 'A=' || opt_a || '|B=' || opt_b || '|C=' || opt_c || '|D=' || opt_d
       ELSE '' END AS choices, gold AS ground_truth, CASE WHEN closed THEN gold END AS ground_truth_label,
  task, source, 'wsi' AS input_kind, 0.5::DOUBLE AS assumed_mpp
FROM qa"""))
def prj_make_samples(spark: SparkSession, sf: str) -> DataFrame:
    made = ops.make_samples(_raw_samples(spark, sf), "demo", assumed_mpp=0.5)
    return made.select(
        "sample_id", "split", "image_id", F.sha2("question", 256).alias("question_hash"),
        choices_key(F.col("choices")).alias("choices"), "ground_truth", "ground_truth_label",
        "task", "source", "input_kind", "assumed_mpp",
    )


@query("prj_public_input", sql.using("qa", body="""
SELECT 'demo:' || doc_id AS sample_id, sha256(question) AS question_hash, task, source,
  CASE WHEN closed THEN 4 ELSE 0 END AS n_choices
FROM qa"""))
def prj_public_input(spark: SparkSession, sf: str) -> DataFrame:
    public = ops.require_public(ops.public_input(ops.make_samples(_raw_samples(spark, sf), "demo")))
    return public.select(
        "sample_id", F.sha2("question", 256).alias("question_hash"), "task", "source",
        F.size("choices").alias("n_choices"),
    )


@query("prj_validate", sql.using("qa", body="""
SELECT reason, count(*) AS rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (
  SELECT doc_id, CASE
    WHEN closed AND doc_id % 13 = 1 THEN 'bad_choices'
    WHEN closed AND doc_id % 13 = 2 THEN 'unmappable_truth'
    WHEN doc_id % 13 = 3 THEN 'empty_question'
    WHEN doc_id % 13 = 4 THEN 'unsafe_path'
    WHEN doc_id % 13 IN (5, 6) THEN 'bad_position'
    WHEN doc_id % 13 IN (7, 8) THEN 'bad_mpp'
    WHEN doc_id % 13 = 9 THEN 'missing_scale'
    ELSE 'ok' END AS reason FROM qa) GROUP BY reason"""))
def prj_validate(spark: SparkSession, sf: str) -> DataFrame:
    fault = F.col("doc_id") % 13
    raw = _raw_samples(spark, sf)
    faulty = raw.withColumns({
        "choices": F.when((fault == 1) & (F.size("choices") > 0), normalize_choices(F.lit('["only"]')))
        .otherwise(F.col("choices")),
        "answer": F.when((fault == 2) & (F.size("choices") > 0), "E").otherwise(F.col("answer")),
        "question": F.when(fault == 3, " \t\n").otherwise(F.col("question")),
        "image_path": F.when(fault == 4, F.concat(F.lit("a/../../"), F.col("img")))
        .otherwise(F.concat(F.lit("a/../"), F.col("img"))),
    })
    made = ops.make_samples(faulty, "demo").withColumns({
        "doc_id": F.substring_index("sample_id", ":", -1).cast("bigint"),
    })
    fault = F.col("doc_id") % 13
    full = made.withColumns({
        "position": F.when(fault == 5, "0").when(fault == 6, "two").otherwise("3"),
        "mpp": F.when(fault == 7, F.lit(-0.5)).when(fault == 8, F.lit(float("nan")))
        .when(fault == 9, F.lit(None)).otherwise(F.lit(0.25)),
    })
    reason = F.coalesce(ops.reject_reason(full), F.lit("ok"))
    return full.select("doc_id", reason.alias("reason")).groupBy("reason").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query("prj_expected_counts", sql.using("qa", body="""
SELECT split, s.n AS expected_questions, f.n AS questions, s.i AS expected_images, f.i AS images,
  s.n = f.n AND s.i = f.i AS ok
FROM (SELECT split, count(*) AS n, count(DISTINCT image_id) AS i FROM qa GROUP BY split) f
JOIN (SELECT split, (SELECT count(*) FROM documents) // 10 AS n,
        (SELECT count(DISTINCT source) FROM documents) AS i FROM (VALUES ('test'), ('test_tiny')) t(split)) s
USING (split)"""))
def prj_expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf).select("split", "image_id")
    configured = table(spark, sf, "documents").agg(
        F.floor(F.count("*") / 10).cast("bigint").alias("_n"), F.count_distinct("source").alias("_i")
    )
    checked = [
        ops.check_expected(rows.filter(F.col("split") == split), None, None)
        .drop("expected_questions", "expected_images", "ok")
        .withColumn("split", F.lit(split))
        for split in ("test", "test_tiny")
    ]
    both = checked[0].unionByName(checked[1]).crossJoin(configured)
    agree = (F.col("_n") == F.col("questions")) & (F.col("_i") == F.col("images"))
    return both.select(
        "split", F.col("_n").alias("expected_questions"), "questions",
        F.col("_i").alias("expected_images"), "images", agree.alias("ok"),
    )


@query("prj_availability", sql.using("qa", "files", """cells AS (
  SELECT *, img IN (SELECT img FROM files) AS here FROM qa)""", body="""
SELECT CASE WHEN grouping(task) = 0 THEN 'task' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS kind,
  coalesce(task, source, '') AS name, count(*) AS release_questions, count(DISTINCT image_id) AS release_images,
  count(*) FILTER (WHERE here) AS available_questions, count(DISTINCT image_id) FILTER (WHERE here) AS available_images,
  count(*) FILTER (WHERE NOT here) AS missing_questions
FROM cells GROUP BY GROUPING SETS ((), (task), (source))"""))
def prj_availability(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf).select("image_id", "img", "task", "source")
    return ops.availability(rows, fx.files(spark, sf))


@query("prj_letter_to_text", sql.using("qa", body="""
SELECT sample_id, opt_a, opt_b, opt_c, opt_d, CASE WHEN closed THEN gold_text ELSE gold END AS gold
FROM qa"""))
def prj_letter_to_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf).withColumn(
        "gold", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.lower("gold"))).otherwise(F.col("gold"))
    ).withColumn("gold", F.when(F.col("closed"), F.col("gold")).otherwise(F.col("gold_text")))
    options = [f"opt_{c}" for c in "abcd"]
    return ops.letter_to_text(rows, options, "gold").select("sample_id", *options, "gold")


# ---------------------------------------------------------------- scalar functions


@query("scl_normalize_text", f"""
SELECT doc_id, sha256({sql.norm('text')}) AS text_key, length({sql.norm('text')}) AS n_chars
FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 1 THEN ' 5 \u00b5m ' WHEN 2 THEN 'e\ufb01' WHEN 3 THEN ' \u0149\u01f0\u03c2' ELSE '' END AS text
      FROM documents)""")
def scl_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("doc_id") % 7
    more = F.when(case == 1, " 5 \u00b5m ").when(case == 2, "e\ufb01").when(case == 3, " \u0149\u01f0\u03c2").otherwise("")
    key = normalize_text(F.col("text"))
    return table(spark, sf, "documents").withColumn("text", F.concat("text", more)).select(
        "doc_id", F.sha2(key, 256).alias("text_key"), F.length(key).cast("bigint").alias("n_chars")
    )


@query("scl_normalize_choices", sql.using("qa", body="""
SELECT sample_id, CASE WHEN NOT closed THEN ''
  WHEN doc_id % 4 = 0 AND doc_id % 3 = 0
    THEN 'A=' || opt_a || '|C=' || opt_b || '|D=' || opt_c || '|E=' || opt_d
  ELSE 'A=' || opt_a || '|B=' || opt_b || '|C=' || opt_c || '|D=' || opt_d END AS choices
FROM qa"""))
def scl_normalize_choices(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf)
    a, b, c, d = [F.col(f"opt_{x}") for x in "abcd"]
    q = lambda column: json_string(column)
    comma = F.lit(", ")
    gap = F.when(F.col("doc_id") % 3 == 0, F.lit(' " ",')).otherwise("")
    listed = F.concat(F.lit("["), q(a), F.lit(","), gap, q(b), comma, q(c), comma, q(d), F.lit("]"))
    mapped = F.concat(
        F.lit('{"a": '), q(a), F.lit(', "(B)": '), q(b), F.lit(', "C.": '), q(c),
        F.lit(', "x": null, "D": '), q(d), F.lit("}"),
    )
    labelled = F.concat(F.lit("A. "), a, F.lit(" B) "), b, F.lit("\nC."), c, F.lit("  D. "), d, F.lit(" "))
    prefixed = F.concat(
        F.lit("["), q(F.concat(F.lit("A) "), a)), comma, q(F.concat(F.lit("(B) "), b)), comma,
        q(F.concat(F.lit("C. "), c)), comma, q(F.concat(F.lit(" (D). "), d)), F.lit("]"),
    )
    kind = F.col("doc_id") % 4
    raw = F.when(~F.col("closed"), "").when(kind == 0, listed).when(kind == 1, mapped).when(
        kind == 2, labelled
    ).otherwise(prefixed)
    return rows.select("sample_id", choices_key(normalize_choices(raw)).alias("choices"))


@query("scl_answer_label", sql.using("qa", "predictions", body=f"""
SELECT sample_id, pred_answer, {sql.answer_label('pred_answer')} AS label,
  coalesce({sql.answer_label('pred_answer')} = gold, false) AS same_as_gold
FROM qa JOIN predictions USING (sample_id)"""))
def scl_answer_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.qa(spark, sf)
    joined = rows.select("sample_id", fx.options(rows).alias("choices"), "gold").join(
        fx.predictions(spark, sf).select("sample_id", "pred_answer"), "sample_id"
    )
    choices = F.col("choices")
    return joined.select(
        "sample_id", "pred_answer", answer_label(F.col("pred_answer"), choices).alias("label"),
        same_answer(choices, F.col("gold"), F.col("pred_answer")).alias("same_as_gold"),
    )


@query("scl_digest", f"""
SELECT doc_id, sha256('[' || {sql.js('source')} || ', ' || {sql.js('lang')} || ', ' || {sql.js('text')} || ']') AS digest
FROM documents""")
def scl_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", digest_list(F.col("source"), F.col("lang"), F.col("text")).alias("digest")
    )


@query("scl_unique_id", """
SELECT doc_id, source || '_' || substr(md5(text), 1, 8) AS unique_id FROM documents""")
def scl_unique_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", unique_id(F.col("source"), F.col("text")).alias("unique_id")
    )


@query("scl_sample_seed", f"""
SELECT event_id, ('0x' || substr(sha256('[128, ' || {sql.js("'ev:' || event_id")} || ', ' || {sql.js('event_type')} || ']'), 1, 8))::BIGINT AS seed
FROM events""")
def scl_sample_seed(spark: SparkSession, sf: str) -> DataFrame:
    sid = F.concat(F.lit("ev:"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", sample_seed(128, sid, F.col("event_type")).alias("seed")
    )


_NAMES = """names AS (SELECT vec_id, x, y, CASE vec_id % 5
  WHEN 0 THEN x || '_' || y || '.jpg' WHEN 1 THEN 'tiles/s1/' || x || '_' || y || '.tar.png'
  WHEN 2 THEN x || '_' || y WHEN 3 THEN x || '-' || y || '.jpg'
  ELSE x || '_' || y || '_5.jpg' END AS name FROM regions)"""


def _tile_names(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.regions(spark, sf)
    x, y, kind = F.col("x").cast("string"), F.col("y").cast("string"), F.col("vec_id") % 5
    name = (
        F.when(kind == 0, F.concat(x, F.lit("_"), y, F.lit(".jpg")))
        .when(kind == 1, F.concat(F.lit("tiles/s1/"), x, F.lit("_"), y, F.lit(".tar.png")))
        .when(kind == 2, F.concat(x, F.lit("_"), y))
        .when(kind == 3, F.concat(x, F.lit("-"), y, F.lit(".jpg")))
        .otherwise(F.concat(x, F.lit("_"), y, F.lit("_5.jpg")))
    )
    return r.select("vec_id", "image_id", "description", "width", "height", name.alias("name"))


@query("scl_coords_from_name", sql.using("regions", _NAMES, body="""
SELECT vec_id, name, CASE WHEN vec_id % 5 IN (0, 2) THEN x END AS x,
  CASE WHEN vec_id % 5 IN (0, 2) THEN y END AS y, split_part(name, '.', 1) AS slide
FROM names"""))
def scl_coords_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return _tile_names(spark, sf).select(
        "vec_id", "name", geo.tile_x(F.col("name")).alias("x"), geo.tile_y(F.col("name")).alias("y"),
        geo.slide_of(F.col("name")).alias("slide"),
    )


FINDINGS_PER_PROMPT = 3


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_fill(template: str, **fields: str) -> str:
    parts = []
    for literal, name in prompts.slots(template):
        if literal:
            parts.append(_quoted(literal))
        if name is not None:
            parts.append(fields[name])
    return "(" + " || ".join(parts) + ")"


_CHOICES_SQL = ("CASE WHEN closed THEN chr(10) || 'Choices:' || chr(10) || 'A. ' || opt_a || chr(10) || 'B. ' "
                "|| opt_b || chr(10) || 'C. ' || opt_c || chr(10) || 'D. ' || opt_d ELSE '' END")
_PREDICTION_SQL = "('{\"answer\": ' || " + sql.js("gold_text") + " || '}')"
_PROMPT_FIELDS = {
    "description": "text_block", "question": "question", "choices": _CHOICES_SQL,
    "answer": _PREDICTION_SQL, "prediction": _PREDICTION_SQL,
    "reflection": "'{\"sufficient\": \"No\"}'", "scale_description": "'absolute magnification'",
    "allowed_scales": "'[10, 20, 40]'", "history": "'[]'",
}
_PROMPTS_SQL = " UNION ALL ".join(
    f"SELECT sample_id, '{protocol}' AS protocol, '{stage}' AS stage, "
    f"sha256({_sql_fill(template, **_PROMPT_FIELDS)}) AS prompt_hash FROM found"
    for protocol, stages in prompts.TEMPLATES.items()
    for stage, template in stages.items()
)


_PATCH_SQL = (
    "'[' || name || ' | Coord=' || CASE WHEN vec_id % 5 IN (0, 2) THEN '(' || x || ',' || y || ')' "
    "ELSE '(unknown)' END || '] ' || description"
)
_FOUND_SQL = f"""found AS (
  SELECT qa.*, '[Current Magnification: 5x]' || chr(10) || chr(10) || t AS text_block
  FROM qa JOIN (
    SELECT doc_id, string_agg({_PATCH_SQL}, chr(10) || chr(10) ORDER BY k) AS t
    FROM documents, (VALUES (1), (2), (3)) z(k), (SELECT count(*) AS n FROM embeddings) c
    JOIN (SELECT r.*, names.name FROM regions r JOIN names USING (vec_id)) p
      ON p.vec_id = (doc_id * k + k) % n
    GROUP BY doc_id) e USING (doc_id))"""


@query("scl_render_prompts", sql.using("qa", "regions", _NAMES, _FOUND_SQL, body=_PROMPTS_SQL))
def scl_render_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of all stages and protocols, over three findings per question."""
    named = _tile_names(spark, sf)
    line = prompts.patch_line(F.col("name"), F.col("description"))
    lines = named.select("vec_id", line.alias("line"))
    total = named.agg(F.count("*").alias("_n"))
    rows = fx.qa(spark, sf)
    k = F.explode(F.sequence(F.lit(1), F.lit(FINDINGS_PER_PROMPT))).alias("k")
    wanted = (
        rows.select("doc_id", k)
        .crossJoin(F.broadcast(total))
        .select("doc_id", "k", ((F.col("doc_id") * F.col("k") + F.col("k")) % F.col("_n")).alias("vec_id"))
    )
    found = wanted.join(lines, "vec_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "line"))).alias("_l")
    )
    body = F.array_join(F.transform("_l", lambda entry: entry["line"]), "\n\n")
    text = F.concat(prompts.magnification_header(F.lit(5)), body)
    joined = rows.join(found.select("doc_id", text.alias("text_block")), "doc_id")
    prediction = F.concat(F.lit('{"answer": '), json_string(F.col("gold_text")), F.lit("}"))
    fields = {
        "description": F.col("text_block"), "question": F.col("question"),
        "choices": prompts.choices_block(fx.options(rows)), "answer": prediction,
        "prediction": prediction, "reflection": F.lit('{"sufficient": "No"}'),
        "scale_description": F.lit(prompts.SCALE_DESCRIPTIONS["physical"]),
        "allowed_scales": F.lit("[10, 20, 40]"), "history": F.lit("[]"),
    }
    rendered = F.array(*[
        F.struct(
            F.lit(protocol).alias("protocol"), F.lit(stage).alias("stage"),
            F.sha2(prompts.fill(template, **fields), 256).alias("prompt_hash"),
        )
        for protocol, stages in prompts.TEMPLATES.items()
        for stage, template in stages.items()
    ])
    return joined.select("sample_id", F.explode(rendered).alias("_p")).select("sample_id", "_p.*")


@query("scl_perceptor_prompts", sql.using("regions", body=f"""
SELECT region_id, kind, CASE kind WHEN 'generic' THEN {_quoted(prompts.GENERIC)}
  WHEN 'context' THEN line || chr(10) || q ELSE line || chr(10) || q || chr(10) ||
    'Missing visual information to inspect: m' || vec_id END AS prompt
FROM (SELECT *, 'Region=' || region_id || '; Original-pixel bounds=(' || x || ',' || y || ',' || width || ','
   || height || '); Magnification=5.0x; Scale source=slide_metadata' AS line,
   {_sql_fill(prompts.QUESTION, question="('question ' || vec_id)")} AS q FROM regions),
  (VALUES ('generic'), ('context'), ('zoom'), ('legacy zoom')) k(kind)"""))
def scl_perceptor_prompts(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.regions(spark, sf)
    vec = F.col("vec_id").cast("string")
    line = prompts.region_line(
        *[F.col(c) for c in ("region_id", "x", "y", "width", "height", "scale_kind", "scale")],
        F.col("magnification_source"),
    )
    question, missing = F.concat(F.lit("question "), vec), F.concat(F.lit("m"), vec)
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), text.alias("prompt"))
        for kind, text in {
            "generic": prompts.perceptor_prompt(prompts.PAPER, line, None, None),
            "context": prompts.perceptor_prompt(prompts.CONTEXT, line, question, None),
            "zoom": prompts.perceptor_prompt(prompts.CONTEXT, line, question, missing),
            "legacy zoom": prompts.perceptor_prompt(prompts.LEGACY, line, question, missing),
        }.items()
    ])
    return r.select("region_id", F.explode(kinds).alias("_k")).select("region_id", "_k.*")


SYSTEM = "You are a careful assistant."


def _styled(name: str) -> Style:
    base = STYLES[name]
    return Style(base.kind, SYSTEM, base.sep, base.sep2)


_SAID = "coalesce(text, '') <> ''"
_CONVERSATION_SQL = {
    "single": f"(CASE WHEN turn = 0 THEN '{SYSTEM}###' ELSE '' END) || role || CASE WHEN {_SAID} THEN ': ' || text || '###' ELSE ':' END",
    "two": f"(CASE WHEN turn = 0 THEN '{SYSTEM} ' ELSE '' END) || role || CASE WHEN {_SAID} THEN ': ' || text || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '</s>' END ELSE ':' END",
    "mpt": f"(CASE WHEN turn = 0 THEN '{SYSTEM}<|im_end|>' ELSE '' END) || role || CASE WHEN {_SAID} THEN text || '<|im_end|>' ELSE '' END",
    "plain": f"(CASE WHEN turn = 0 THEN '{SYSTEM}' ELSE '' END) || CASE WHEN {_SAID} THEN text || chr(10) ELSE '' END",
    "llama_2": f"CASE WHEN NOT ({_SAID}) THEN '' WHEN turn % 2 = 0 THEN (CASE WHEN turn = 0 THEN '' ELSE '<s>' END) || '[INST] ' || (CASE WHEN turn = 0 THEN '<<SYS>>' || chr(10) || '{SYSTEM}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END) || text || ' [/INST]' ELSE ' ' || text || ' </s>' END",
}


# The given conversations, and long ones: twenty neighbours in a row.
_LONG_CONVERSATIONS_SQL = """SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT -1 - conv_id // 20, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) - 1, role, text
FROM conversations"""


@query("scl_render_conversation", " UNION ALL ".join(
    f"""SELECT conv_id, '{name}' AS style, count(*) AS turns,
  sha256(string_agg({body}, '' ORDER BY turn)) AS prompt_hash
FROM (SELECT conv_id, turn, role, CASE WHEN turn > 0 AND (conv_id + turn) % 9 = 0 THEN NULL ELSE text END AS text
      FROM ({_LONG_CONVERSATIONS_SQL})) GROUP BY conv_id""" for name, body in _CONVERSATION_SQL.items()))
def scl_render_conversation(spark: SparkSession, sf: str) -> DataFrame:
    silent = (F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 9 == 0)
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    given.createOrReplaceTempView("given_turns")
    long = spark.sql(_LONG_CONVERSATIONS_SQL.replace("FROM conversations", "FROM given_turns").replace("//", "div"))
    turns = long.withColumn("text", F.when(~silent, F.col("text")))
    styles = {name: _styled(name) for name in _CONVERSATION_SQL}
    return render_styles(turns, styles, ["conv_id"]).select(
        "conv_id", "style", "turns", F.sha2("prompt", 256).alias("prompt_hash")
    )


_RESPONSE_OK = """(conv_id * 3 + turn) % 5 <> 4 AND CASE conv_id % 4
  WHEN 1 THEN (conv_id + turn) % 2 = 0 WHEN 2 THEN turn % 3 <> 2 ELSE true END"""


@query("scl_validate_responses", f"""
SELECT conv_id || ':' || (turn // 2) AS call_id,
  CASE conv_id % 4 WHEN 0 THEN 'predict' WHEN 1 THEN 'reflect' WHEN 2 THEN 'missing_info' ELSE 'final' END AS stage,
  CASE WHEN bool_or({_RESPONSE_OK}) THEN 'ok' ELSE 'invalid' END AS status,
  min(turn % 2) FILTER (WHERE {_RESPONSE_OK}) AS attempt,
  arg_min(CASE conv_id % 4 WHEN 1 THEN 'Yes' ELSE sha256(text) END, turn % 2) FILTER (WHERE {_RESPONSE_OK}) AS content
FROM conversations GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY conv_id, turn // 2, conv_id % 4"))
def scl_validate_responses(spark: SparkSession, sf: str) -> DataFrame:
    checked = validate_responses(
        fx.responses(spark, sf).select("call_id", "stage", "attempt", "raw"), prompts.PAPER
    )
    key = (
        F.when(F.col("stage") == "predict", F.get_json_object("object", "$.thinking_steps"))
        .when(F.col("stage") == "missing_info", F.get_json_object("object", "$.missing_info"))
        .otherwise(F.get_json_object("object", "$.explanation"))
    )
    content = F.when(
        F.col("stage") == "reflect", F.get_json_object("object", "$.sufficient")
    ).otherwise(F.sha2(key, 256))
    return checked.select("call_id", "stage", "status", "attempt", content.alias("content"))


@query("scl_strip_think", f"""
SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN sha256({sql.strip('text')}) WHEN 1 THEN sha256({sql.strip("('answer ' || text)")})
  WHEN 2 THEN sha256('') WHEN 3 THEN sha256({sql.strip("('b' || text)")})
  ELSE sha256({sql.strip("('x' || 'y' || text)")}) END AS kept
FROM documents""")
def scl_strip_think(spark: SparkSession, sf: str) -> DataFrame:
    text, kind = F.col("text"), F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("<think>"), text, F.lit("</think> answer "), text))
        .when(kind == 2, F.concat(F.lit("start <think>"), text))
        .when(kind == 3, F.concat(text, F.lit("</think>b"), text))
        .otherwise(F.concat(F.lit("x<think>\n1</think>y<think>2\n</think>"), text))
    )
    return table(spark, sf, "documents").select("doc_id", F.sha2(strip_think(raw), 256).alias("kept"))


_VECTORS = """vectors AS (SELECT vec_id, CASE vec_id % 50
  WHEN 7 THEN list_transform(embedding::DOUBLE[], lambda v: 0.0::DOUBLE)
  WHEN 8 THEN list_transform(embedding::DOUBLE[], lambda v: 'nan'::DOUBLE)
  WHEN 9 THEN (embedding::DOUBLE[])[1:63] ELSE embedding::DOUBLE[] END AS v FROM embeddings)"""


@query("scl_unit_rows", f"""WITH {_VECTORS}
SELECT vec_id, vec_id % 50 NOT IN (7, 8, 9) AS usable,
  CASE WHEN vec_id % 50 NOT IN (7, 8, 9) THEN 1.0::DOUBLE END AS length,
  CASE WHEN vec_id % 50 NOT IN (7, 8, 9) THEN round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS first,
  CASE WHEN vec_id % 50 NOT IN (7, 8, 9) THEN round(v[64] / sqrt(list_dot_product(v, v)), 6) END AS last
FROM vectors""")
def scl_unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    kind, e = F.col("vec_id") % 50, F.col("embedding")
    vector = (
        F.when(kind == 7, F.transform(e, lambda v: F.lit(0.0).cast("float")))
        .when(kind == 8, F.transform(e, lambda v: F.lit(float("nan")).cast("float")))
        .when(kind == 9, F.slice(e, 1, 63))
        .otherwise(e)
    )
    good, bad = unit_rows(table(spark, sf, "embeddings").select("vec_id", vector.alias("v")), "v", 64)
    none = F.lit(None).cast("double")
    return good.select(
        "vec_id", F.lit(True).alias("usable"), F.round(norm(F.col("v")), 6).alias("length"),
        F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"),
    ).unionByName(
        bad.select("vec_id", F.lit(False).alias("usable"), none.alias("length"), none.alias("first"), none.alias("last"))
    )


@query("scl_extract_links", """
WITH links AS (
  SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) AS position
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages))
SELECT page_id, position, url, picked FROM (
  SELECT page_id, position, url, position = page_id % 9 + 1 AS picked FROM links
  UNION ALL
  SELECT page_id, page_id % 9 + 1, NULL, true FROM pages
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.page_id = pages.page_id AND l.position = pages.page_id % 9 + 1))""")
def scl_extract_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    links = extract_links(pages, "page_id", "html")
    wanted = pages.select("page_id", (F.col("page_id") % 9 + 1).cast("int").alias("position"))
    picked = pick_links(links, wanted, "page_id").select(
        "page_id", F.col("position").cast("bigint").alias("position"), "url", F.lit(True).alias("picked")
    )
    rest = links.select(
        "page_id", (F.col("position") + 1).cast("bigint").alias("position"), "url"
    ).filter(F.col("position") != F.col("page_id") % 9 + 1)
    return picked.unionByName(rest.withColumn("picked", F.lit(False)))


@query("scl_indexed_links", """
WITH marked AS (
  SELECT page_id, unnest(u) AS url, 2 * (generate_subscripts(u, 1) - 1) AS place
  FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages)
  UNION ALL SELECT page_id, 'other', 0 FROM pages WHERE page_id % 7 = 0),
counted AS (SELECT page_id, place, count(DISTINCT url) AS urls, min(url) AS url FROM marked GROUP BY ALL),
exposed AS (SELECT page_id, count(*) AS exposed, bool_or(urls > 1) AS bad FROM counted GROUP BY 1)
SELECT page_id, page_id % 9 + 1 AS position, CASE WHEN NOT coalesce(bad, false) THEN c.url END AS url,
  CASE WHEN coalesce(bad, false) THEN 'conflict' WHEN c.url IS NULL THEN 'missing' ELSE 'found' END AS status,
  coalesce(exposed, 0) AS exposed
FROM pages LEFT JOIN exposed USING (page_id)
  LEFT JOIN counted c USING (page_id) WHERE c.place = page_id % 9
UNION ALL
SELECT page_id, page_id % 9 + 1, NULL, CASE WHEN coalesce(bad, false) THEN 'conflict' ELSE 'missing' END, coalesce(exposed, 0)
FROM pages LEFT JOIN exposed USING (page_id)
WHERE NOT EXISTS (SELECT 1 FROM counted c WHERE c.page_id = pages.page_id AND c.place = pages.page_id % 9)""")
def scl_indexed_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links as numbered media entries with gaps; every seventh page contradicts itself at 0."""
    pages = table(spark, sf, "pages")
    urls = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    entry = lambda url, i: F.concat(F.lit("media:"), (i * 2).cast("string"), F.lit('="'), url, F.lit('"'))
    entries = F.array_join(F.transform(urls, entry), " ")
    odd = F.when(F.col("page_id") % 7 == 0, ' media:0="other"').otherwise("")
    marked = pages.select("page_id", F.concat(entries, odd).alias("html"))
    links = indexed_links(marked, "page_id", "html", r'media:(\d+)="([^"]*)"')
    wanted = pages.select("page_id", (F.col("page_id") % 9 + 1).cast("bigint").alias("position"))
    return pick_indexed(links, wanted, "page_id")


@query("scl_scale", sql.using("slides", "scaled", body="""
SELECT image_id, round(mpp, 9) AS mpp, mpp_source, round(10.0::DOUBLE / mpp, 9) AS native_magnification,
  greatest(1, round_even(4096 * 5 / (10.0::DOUBLE / mpp), 0))::BIGINT AS output_px
FROM scaled"""))
def scl_scale(spark: SparkSession, sf: str) -> DataFrame:
    return scale_columns(fx.slides(spark, sf)).select(
        "image_id", F.round("mpp", 9).alias("mpp"), "mpp_source",
        F.round("native_magnification", 9).alias("native_magnification"), "output_px",
    )


@query("jn_unique_image", sql.using("qa", "files", body="""
SELECT sample_id, coalesce(n, 0) AS n_paths, CASE WHEN n = 1 THEN p END AS path
FROM qa LEFT JOIN (SELECT img, count(*) AS n, min(path) AS p FROM files
  WHERE path NOT LIKE '%.txt' GROUP BY img) f USING (img)"""))
def jn_unique_image(spark: SparkSession, sf: str) -> DataFrame:
    from tesserae.sources.files import image_index

    rows = fx.qa(spark, sf).select("sample_id", F.col("img").alias("image_id"))
    return resolve_images(rows, image_index(fx.files(spark, sf))).select("sample_id", "n_paths", "path")
