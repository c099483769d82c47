"""Question annotations from CSV and JSON releases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.choices import choices_from_columns, no_options, normalize_choices
from tesserae.functions.text import json_list, json_string, strip
from tesserae.operators.joins import map_cases
from tesserae.operators.samples import make_samples
from tesserae.runtime import require_empty
from tesserae.sources.arrays import json_elements

# Columns of the slide question table and the mandatory parts of the nested one.
SLIDE_COLUMNS = ("ID", "Slide", "Task", "Question", "A", "B", "C", "D", "Answer")
COHORT_COLUMNS = ("ID", "Slide", "Tumor", "Task", "Question", "A", "B", "C", "D", "Answer", "Output")
DEFAULT_TASK = "Tumor subtype"
NESTED_SOURCES = ("PubMed", "SocialPath", "Atlas", "EduContent", "PathCLS")
NESTED_SPLITS = ("test", "test_tiny")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All-string CSV with a header, quoted line breaks and an optional byte order mark."""
    schema = ", ".join(f"`{name}` string" for name in columns)
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True
    )


def slide_samples(
    rows: DataFrame, dataset: str, assumed_mpp: float | None = None, cohorts: bool = False
) -> DataFrame:
    """Samples from slide question rows.

    With ``cohorts`` the tumor column is the source, a blank task has a default and the
    released prediction column is never read.
    """
    choices = choices_from_columns(*[(label, F.col(label)) for label in "ABCD"])
    task = F.col("Task")
    if cohorts:
        trimmed = strip(F.coalesce(task, F.lit("")))
        task = F.when(trimmed == "", DEFAULT_TASK).otherwise(trimmed)
    ready = rows.select(
        F.col("ID").alias("sid"),
        strip(F.col("Slide")).alias("image_id"),
        F.col("Question").alias("question"),
        choices.alias("choices"),
        F.col("Answer").alias("answer"),
        task.alias("task"),
        (F.col("Tumor") if cohorts else F.lit("")).alias("source"),
    )
    return make_samples(ready, dataset, "test", assumed_mpp=assumed_mpp)


def read_slide_qa_csv(
    spark: SparkSession,
    path: str,
    dataset: str,
    assumed_mpp: float | None = None,
    cohorts: bool = False,
) -> DataFrame:
    columns = COHORT_COLUMNS if cohorts else SLIDE_COLUMNS
    return slide_samples(read_csv(spark, path, columns), dataset, assumed_mpp, cohorts)


def _listed(options: Column) -> Column:
    """Options of a list cell; a missing or empty list is an open question."""
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, no_options()).otherwise(
        normalize_choices(F.to_json(options))
    )


_NESTED_ROW = (
    "struct<No:string,img:string,question:string,options:array<string>,answer:string,"
    "source_img:string>"
)
_NESTED = f"map<string,map<string,array<{_NESTED_ROW}>>>"


def nested_rows(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """(source, split, No, img, question, options, answer, source_img) of nested documents."""
    return (
        payloads.select(F.explode(F.from_json(F.col(payload), _NESTED)).alias("source", "_splits"))
        .select("source", F.explode("_splits").alias("split", "_rows"))
        .selectExpr("source", "split", "inline(_rows)")
    )


def missing_parts(rows: DataFrame, sources: Sequence[str], splits: Sequence[str]) -> DataFrame:
    """Mandatory (source, split) pairs without a single row."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(
        [(source, split) for source in sources for split in splits], "source string, split string"
    )
    return wanted.join(rows.select("source", "split").distinct(), ["source", "split"], "left_anti")


def identity_digest(source: Column, img: Column, question: Column, options: Column) -> Column:
    """Content identity of a question; equal rows are the same question."""
    listed = F.concat(
        F.lit("["), F.array_join(F.transform(options, json_string), ", "), F.lit("]")
    )
    return F.sha2(
        json_list(json_string(source), json_string(img), json_string(question), listed), 256
    )


def repeated_questions(rows: DataFrame) -> DataFrame:
    """(identity, rows, first) of questions that are in several rows: ``first`` is the least
    (source, split, No)."""
    options = F.coalesce("options", F.array().cast("array<string>"))
    identity = identity_digest(F.col("source"), F.col("img"), F.col("question"), options)
    grouped = rows.groupBy(identity.alias("identity")).agg(
        F.count("*").alias("rows"), F.min(F.concat_ws("/", "source", "split", "No")).alias("first")
    )
    return grouped.filter("rows > 1")


def nested_samples(rows: DataFrame, dataset: str, image_root: str = "") -> DataFrame:
    prefix = image_root.rstrip("/") + "/" if image_root else ""
    ready = rows.select(
        F.concat_ws(":", "source", "split", "No").alias("sid"),
        "split",
        F.col("img").alias("image_id"),
        F.concat(F.lit(prefix), F.col("img")).alias("image_path"),
        "question",
        _listed(F.col("options")).alias("choices"),
        "answer",
        "source",
    )
    return make_samples(ready, dataset, input_kind="roi")


def read_nested_qa_json(
    spark: SparkSession,
    path: str,
    sources: Sequence[str] = NESTED_SOURCES,
    splits: Sequence[str] = NESTED_SPLITS,
    lines: bool = False,
    dataset: str = "nested",
    image_root: str = "",
) -> DataFrame:
    """Samples of a nested release: a document per file, or with ``lines`` one per line."""
    documents = spark.read.text(path, wholetext=not lines)
    rows = nested_rows(documents).filter(
        F.col("source").isin(*sources) & F.col("split").isin(*splits)
    )
    lacking = [f"{row.source}/{row.split}" for row in missing_parts(rows, sources, splits).collect()]
    if lacking:
        raise ValueError(f"release lacks {sorted(lacking)}")
    require_empty(repeated_questions(rows), "repeated question")
    return nested_samples(rows, dataset, image_root)


_CASE = "struct<Id:string,Question:string,Choice:array<string>,Answer:string>"


def case_rows(payloads: DataFrame, payload: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, position, case_id, question, choices, answer) of JSON arrays of case questions."""
    listed = payloads.select(
        *keys, F.posexplode(F.from_json(F.col(payload), f"array<{_CASE}>")).alias("position", "_c")
    )
    return listed.select(
        *keys,
        "position",
        F.col("_c.Id").alias("case_id"),
        F.col("_c.Question").alias("question"),
        _listed(F.col("_c.Choice")).alias("choices"),
        F.col("_c.Answer").alias("answer"),
    )


def case_elements(elements: DataFrame, element: str, keys: Sequence[str] = ()) -> DataFrame:
    """The same of single elements with their position; an element that is no object is an error."""
    read = elements.select(*keys, "position", F.from_json(F.col(element), _CASE).alias("_c"))
    require_empty(read.filter("_c IS NULL").select(*keys, "position"), "element that is no question")
    return read.select(
        *keys,
        "position",
        F.col("_c.Id").alias("case_id"),
        F.col("_c.Question").alias("question"),
        _listed(F.col("_c.Choice")).alias("choices"),
        F.col("_c.Answer").alias("answer"),
    )


def case_samples(
    rows: DataFrame,
    slide_map: DataFrame,
    sid: Column,
    image_root: str = "",
    dataset: str = "cases",
    require_images: bool = False,
) -> DataFrame:
    mapped = map_cases(rows, slide_map, image_root, require_images)
    if require_images:
        require_empty(mapped.filter("unmapped"), "case without a slide")
    return make_samples(mapped.withColumn("sid", sid), dataset, "test")


def read_case_qa_json(
    spark: SparkSession,
    path: str,
    slide_map: DataFrame,
    image_root: str = "",
    require_images: bool = False,
) -> DataFrame:
    """One JSON array file of any size; the position in the array is the question's id."""
    elements = json_elements(spark, path)
    require_empty(elements.select("file").distinct().groupBy().count().filter("count > 1"), "more than one file")
    rows = case_elements(elements, "element")
    return case_samples(
        rows, slide_map, F.col("position").cast("string"), image_root, require_images=require_images
    )
