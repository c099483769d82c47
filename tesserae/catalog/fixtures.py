"""Inputs of the registered queries, derived from the given tables with column expressions.

Every function here has a twin in :mod:`tesserae.catalog.sql` with the same formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.choices import no_options, option
from tesserae.functions.text import json_string
from tesserae.runtime import table

SIZES = ("short", "medium", "long", "huge")


def _word(index: Column) -> Column:
    return F.get(F.array(*[F.lit(word) for word in SIZES]), index.cast("int"))


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """Question rows: how long is the document? Four rotated options, or open."""
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    s = F.when(n < 850, 0).when(n < 1500, 1).when(n < 2700, 2).otherwise(3)
    r = F.col("doc_id") % 4
    is_open = F.col("doc_id") % 5 == 0
    texts = [F.when(~is_open, _word((F.lit(i) + r) % 4)).alias(f"opt_{'abcd'[i]}") for i in range(4)]
    letter = F.char(65 + (s - r + 4) % 4)
    return d.select(
        "doc_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("sample_id"),
        F.col("source").alias("image_id"),
        F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("img"),
        F.col("lang").alias("task"),
        "source",
        F.col("text").alias("question"),
        F.when(F.col("doc_id") % 10 == 0, "test_tiny").otherwise("test").alias("split"),
        *texts,
        F.when(is_open, _word(s)).otherwise(letter).alias("gold"),
        _word(s).alias("gold_text"),
        (~is_open).alias("closed"),
        "n_chars",
    )


def options(df: DataFrame) -> Column:
    """The four options as an array, or none for an open question."""
    listed = F.array(*[option(F.lit(c.upper()), F.col(f"opt_{c}")) for c in "abcd"])
    return F.when(F.col("closed"), listed).otherwise(no_options())


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Scored form of the question rows."""
    rows = qa(spark, sf)
    return rows.select(
        "sample_id",
        "image_id",
        "task",
        "source",
        options(rows).alias("choices"),
        F.col("gold").alias("ground_truth"),
        F.when(F.col("closed"), F.col("gold")).alias("ground_truth_label"),
    )


def predictions(spark: SparkSession, sf: str, mul: int = 7, add: int = 3) -> DataFrame:
    """Answers in eleven forms: none, invalid, right in many spellings, wrong, unclear."""
    c = (F.col("doc_id") * mul + add) % 11
    gold, text = F.col("gold"), F.col("gold_text")
    after = F.char(65 + (F.ascii(gold) - 65 + 1) % 4)
    next_word = F.when(text == "huge", "short").when(text == "short", "medium").when(
        text == "medium", "long"
    ).otherwise("huge")
    closed = (
        F.when(c.isin(1, 2), gold)
        .when(c == 3, F.concat(F.lit("("), gold, F.lit(")")))
        .when(c == 4, F.concat(F.lower(gold), F.lit(".")))
        .when(c == 5, F.concat(gold, F.lit(") "), F.upper(text)))
        .when(c == 6, F.concat(F.lit("  "), F.upper(text), F.lit("\t")))
        .when(c == 7, after)
        .when(c == 8, F.concat(after, F.lit(") "), text))
        .when(c == 9, F.concat(F.lit("Answer: "), gold))
        .otherwise("")
    )
    open_ = (
        F.when(c.isin(1, 2, 3), text)
        .when(c.isin(4, 5, 6), F.concat(F.lit(" "), F.upper(text), F.lit("\n")))
        .when(c.isin(7, 8), next_word)
        .when(c == 9, F.concat(F.lit("Answer: "), text))
        .otherwise("")
    )
    return (
        qa(spark, sf)
        .filter(c != 0)
        .select(
            "doc_id",
            "sample_id",
            F.when(c == 1, "invalid").otherwise("ok").alias("status"),
            F.when(F.col("closed"), closed).otherwise(open_).alias("pred_answer"),
            F.lit("run0").alias("run_hash"),
            (F.col("doc_id") % 16).alias("shard"),
        )
    )


def _image_of(label: Column, vec_id: Column) -> Column:
    odd = F.concat(label.cast("string"), F.lit("_"), (vec_id % 16).cast("string"))
    return F.when(label % 2 == 0, label.cast("string")).otherwise(odd)


def region_id(vec_id: Column) -> Column:
    return F.lpad(vec_id.cast("string"), 10, "0")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as tiles of some large and many small images."""
    v, label = F.col("vec_id"), F.col("label")
    side = F.when(label == 8, 1).otherwise(4096).cast("bigint")
    return table(spark, sf, "embeddings").select(
        _image_of(label, v).alias("image_id"),
        region_id(v).alias("region_id"),
        F.lit("/unused").alias("image_path"),
        (v % 8 * 4096).alias("x"),
        (F.floor(v / 8) * 4096).alias("y"),
        side.alias("width"),
        side.alias("height"),
        F.lit(512).cast("bigint").alias("output_width"),
        F.lit(512).cast("bigint").alias("output_height"),
        F.lit("physical").alias("scale_kind"),
        F.lit(5.0).alias("scale"),
        F.lit(0.25).alias("mpp"),
        F.lit("slide_metadata").alias("magnification_source"),
        F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit("generic "), v.cast("string")).alias("description"),
        F.col("embedding").alias("vector"),
        v.alias("vec_id"),
    )


def agent_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per embedding, about the image that embedding belongs to."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("query_id"),
        _image_of(F.col("label"), v).alias("image_id"),
        F.concat(F.lit("question "), v.cast("string")).alias("question"),
    )


def slides(spark: SparkSession, sf: str) -> DataFrame:
    """Slide sizes and scale metadata from the parts table."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    kind = p % 4
    return table(spark, sf, "part").select(
        F.concat(F.lit("slide_"), p.cast("string")).alias("image_id"),
        F.concat(F.lit("/slides/"), p.cast("string"), F.lit(".svs")).alias("image_path"),
        (4096 * (1 + size % 9) + p * 37 % 4096).alias("width"),
        (4096 * (1 + p * 13 % 7) + p * 53 % 4096).alias("height"),
        F.when(kind == 0, 0.25).when(kind == 1, 0.5).alias("slide_mpp"),
        F.when(kind == 2, 40).alias("objective_power"),
        F.when(kind == 3, 0.5).alias("assumed_mpp"),
        F.when(p % 17 == 5, "roi").otherwise("wsi").alias("input_kind"),
        p.alias("p_partkey"),
    )


def image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Many question rows per image, with rare strata, from the orders table."""
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o.alias("order_id"),
        F.concat(F.lit("ord:"), o.cast("string")).alias("sample_id"),
        F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("image_id"),
        (o % 3 != 0).alias("closed"),
        F.col("o_orderpriority").alias("task"),
        F.when(o % 997 == 0, "rare").otherwise(F.col("o_orderstatus")).alias("answer_text"),
        F.concat(F.lit("clerk"), (F.col("o_custkey") % 7).cast("string")).alias("source"),
    )


def order_images(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the images that :func:`image_rows` asks about."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.lpad(c.cast("string"), 12, "0").alias("image_id"),
        (4096 * (1 + c % 9) + c * 37 % 4096).alias("width"),
        (4096 * (1 + c * 13 % 7) + c * 53 % 4096).alias("height"),
        F.when(c % 17 == 5, "roi").otherwise("wsi").alias("input_kind"),
    )


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("case_id"),
        F.col("event_type").alias("stage"),
        F.col("value").alias("seconds"),
        (F.length("props") + F.get_json_object("props", "$.k").cast("bigint")).alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
    )


SUFFIXES = (".jpg", ".JPEG", ".svs", ".txt")


def _suffix() -> Column:
    return F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 4).cast("int"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file listing with gaps, second copies and wrong sizes, one image per document."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    name = F.concat(F.lit("img_"), F.col("doc_id").cast("string"), _suffix())
    places = F.when(F.col("doc_id") % 50 == 1, F.array(F.lit("root/"), F.lit("root/copy/"))).otherwise(
        F.array(F.lit("root/"))
    )
    size = F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    return (
        d.filter(F.col("doc_id") % 7 != 0)
        .withColumn("_place", F.explode(places))
        .select(
            "doc_id",
            F.concat("_place", "source", F.lit("/"), name).alias("path"),
            F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("img"),
            size.alias("size"),
        )
    )


def originals(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted images with the name they have in an archive."""
    name = F.concat(F.lit("img_"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id",
        name.alias("name"),
        F.concat(F.lit("pre/"), F.col("source"), F.lit("/"), name, _suffix()).alias("original"),
        "n_chars",
        "source",
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn as reference, the following turn of the conversation as hypothesis."""
    c = table(spark, sf, "conversations")
    asked = c.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("ref")
    )
    told = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    row_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return asked.join(told, ["conv_id", "turn"]).select(row_id.alias("row_id"), "ref", "hyp")


STAGES = ("predict", "reflect", "missing_info", "final")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Raw model responses around conversation texts, in five shapes; two attempts a call."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), json_string(F.col("text"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), (conv % 4).cast("int"))
    flip = (conv + turn) % 2 == 0
    level = F.when(turn % 3 == 0, F.lit('"20"')).when(turn % 3 == 1, F.lit("40")).otherwise(
        F.lit('"None"')
    )
    body = (
        F.when(stage == "predict", F.concat(F.lit('{"answer": "A", "thinking_steps": '), text, F.lit("}")))
        .when(stage == "reflect", F.when(flip, '{"sufficient": "Yes"}').otherwise('{"sufficient": "maybe"}'))
        .when(
            stage == "missing_info",
            F.concat(
                F.lit('{"missing_info": '), text,
                F.lit(', "zoom_recommendation": "Yes", "recommended_zoom_level": '), level,
                F.lit(', "zoom_reason": "detail"}'),
            ),
        )
        .otherwise(F.concat(F.lit('{"answer": "B", "explanation": '), text, F.lit("}")))
    )
    shape = (conv * 3 + turn) % 5
    raw = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit('<think>{"answer": 1}</think>'), body))
        .when(shape == 3, F.concat(F.lit("Result {so far}: "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit("{broken "), F.replace(body, F.lit("{"), F.lit("("))))
    )
    return table(spark, sf, "conversations").select(
        F.concat_ws(":", conv.cast("string"), F.floor(turn / 2).cast("string")).alias("call_id"),
        stage.alias("stage"),
        (turn % 2).alias("attempt"),
        raw.alias("raw"),
        "conv_id",
        "turn",
    )
