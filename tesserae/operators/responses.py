"""Validation of raw model responses per stage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.choices import answer_label
from tesserae.functions.geometry import PHYSICAL_TARGETS, RELATIVE_TARGETS
from tesserae.functions.prompts import LEGACY
from tesserae.functions.responses import first_json_object, strip_think
from tesserae.functions.text import is_blank

ALLOWED_LEVELS = {"physical": PHYSICAL_TARGETS, "relative": RELATIVE_TARGETS}

# Keys that a response of each stage must have.
STAGE_KEYS = {
    "predict": ("answer", "thinking_steps"),
    "reflect": ("sufficient",),
    "missing_info": ("missing_info", "zoom_recommendation", "zoom_reason"),
    "final": ("answer", "explanation"),
}
# Zoom levels that may also arrive as strings, and the word for none.
LEVEL_WORDS = ("10", "20", "40")
NO_LEVEL = "None"

_TYPES = {str: "string", bool: "bool", int: "int", float: "float", type(None): "null"}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def value_types(objects: pd.Series) -> pd.Series:
    """JSON type of every top-level value."""
    def types(text: str) -> dict[str, str]:
        return {key: _TYPES.get(type(value), "nested") for key, value in json.loads(text).items()}

    return objects.map(types, na_action="ignore").astype(object)


def level_key(protocol: str) -> str:
    return "zoom_level" if protocol == LEGACY else "recommended_zoom_level"


def parse_responses(calls: DataFrame, raw: str, protocol: str) -> DataFrame:
    """Add ``object`` (JSON text), ``fields`` (values as text) and ``types``."""
    text = F.col(raw) if protocol == LEGACY else strip_think(F.col(raw))
    found = calls.withColumn("object", first_json_object(text))
    return found.withColumns(
        {
            "fields": F.from_json("object", "map<string,string>"),
            "types": value_types("object"),
        }
    )


def _is_string(key: str) -> Column:
    return F.coalesce(F.col("types")[key] == "string", F.lit(False))


def _says(key: str, *words: str) -> Column:
    return F.coalesce(F.lower(F.col("fields")[key]).isin(*words), F.lit(False)) & _is_string(key)


def zoom_level(protocol: str) -> Column:
    """The level as a number; null for none or for anything that is not a level."""
    key = level_key(protocol)
    value, kind = F.col("fields")[key], F.col("types")[key]
    if protocol == LEGACY:
        return F.when(kind.isin("int", "float"), value.try_cast("double")).cast("int")
    as_word = (kind == "string") & value.isin(*LEVEL_WORDS)
    return F.when((kind == "int") | as_word, value.try_cast("int"))


def _level_ok(protocol: str, scale_kind: str) -> Column:
    key = level_key(protocol)
    value, kind, level = F.col("fields")[key], F.col("types")[key], zoom_level(protocol)
    allowed = F.coalesce(level.isin(*ALLOWED_LEVELS[scale_kind]), F.lit(False))
    no_zoom = _says("zoom_recommendation", "no")
    present = kind.isNotNull()
    if protocol == LEGACY:
        whole = F.coalesce(value.try_cast("double") == level, F.lit(False))
        return present & (no_zoom | (allowed & whole))
    none = (kind == "null") | ((kind == "string") & (value == NO_LEVEL))
    return F.coalesce(present & (allowed | (none & no_zoom)), F.lit(False))


def stage_valid(parsed: DataFrame, protocol: str, scale_kind: str = "physical") -> Column:
    """Does the parsed response obey the rules of its ``stage``?

    Final answers are checked against ``choices`` when the frame has them.
    """
    answer_fits = F.lit(True)
    if "choices" in parsed.columns:
        answer_fits = (F.size("choices") <= 0) | answer_label(
            F.col("fields")["answer"], F.col("choices")
        ).isNotNull()
    rules = {
        "predict": _is_string("answer") & _is_string("thinking_steps"),
        "reflect": _says("sufficient", "yes", "no"),
        "missing_info": _is_string("missing_info")
        & ~is_blank(F.col("fields")["missing_info"])
        & (F.col("types")["zoom_reason"].isNotNull() if protocol == LEGACY else _is_string("zoom_reason"))
        & _says("zoom_recommendation", "yes", "no")
        & _level_ok(protocol, scale_kind),
        "final": _is_string("answer")
        & ~is_blank(F.col("fields")["answer"])
        & _is_string("explanation")
        & answer_fits,
    }
    verdict = F.lit(False)
    for stage, rule in rules.items():
        verdict = F.when(F.col("stage") == stage, rule).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def validate_responses(
    calls: DataFrame, protocol: str, retries: int = 1, scale_kind: str = "physical"
) -> DataFrame:
    """First valid response of every call within ``retries + 1`` attempts.

    ``calls`` has (call_id, stage, attempt, raw[, choices]). Returns (call_id, stage, status,
    attempt, object).
    """
    parsed = parse_responses(calls.filter(F.col("attempt") <= retries), "raw", protocol)
    valid = stage_valid(parsed, protocol, scale_kind)
    good = F.when(valid, F.col("attempt"))
    return (
        parsed.withColumn("_good", good)
        .groupBy("call_id", "stage")
        .agg(F.min("_good").alias("attempt"), F.min_by("object", "_good").alias("object"))
        .select(
            "call_id",
            "stage",
            F.when(F.col("attempt").isNull(), "invalid").otherwise("ok").alias("status"),
            "attempt",
            F.when(F.col("attempt").isNotNull(), F.col("object")).alias("object"),
        )
    )


def decide(answered: DataFrame, protocol: str) -> DataFrame:
    """Decision columns from the objects of the three evaluation stages."""
    level = f"$.{level_key(protocol)}"
    value = F.get_json_object("_missing_info", level)
    sufficient = F.get_json_object("_reflect", "$.sufficient")
    missing = F.lower(sufficient) == "no"
    return answered.withColumns(
        {
            "answer": F.get_json_object("_predict", "$.answer"),
            "thinking_steps": F.get_json_object("_predict", "$.thinking_steps"),
            "sufficient": sufficient,
            "missing_info": F.when(missing, F.get_json_object("_missing_info", "$.missing_info")),
            "zoom_recommendation": F.when(
                missing, F.get_json_object("_missing_info", "$.zoom_recommendation")
            ),
            "zoom_level": F.when(missing, value.try_cast("double").cast("int")),
        }
    )
