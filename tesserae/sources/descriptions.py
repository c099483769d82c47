"""Per-region description parts in the form ``{slide: {patch: text}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = "map<string,map<string,string>>"


def _parsed(payload: str) -> Column:
    """The parts of a payload that is one JSON document and nothing else, or null.

    The parser stops behind the first value. Inside of a list and of an object, what follows it
    would have to close both at once.
    """
    text = F.col(payload)
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_PARTS}>")
    inside = F.from_json(F.concat(F.lit('{"v": '), text, F.lit("}")), f"struct<v: {_PARTS}>")
    return F.when((F.size(listed) == 1) & inside["v"].isNotNull(), listed[0])


def description_rows(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """(file, slide, patch, text); unreadable payloads give no rows."""
    return (
        payloads.select("file", F.explode(_parsed(payload)).alias("slide", "_p"))
        .select("file", "slide", F.explode("_p").alias("patch", "text"))
    )


def merge_descriptions(payloads: DataFrame, payload: str = "value") -> DataFrame:
    """One text per (slide, patch): that of the last file by name."""
    return (
        description_rows(payloads, payload)
        .groupBy("slide", "patch")
        .agg(F.max_by("text", "file").alias("text"), F.max("file").alias("file"))
    )


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    texts = spark.read.text(path, wholetext=True)
    return merge_descriptions(
        texts.select(F.col("_metadata.file_name").alias("file"), "value")
    )


def unreadable(payloads: DataFrame, payload: str = "value") -> DataFrame:
    return payloads.filter(_parsed(payload).isNull()).select("file")
