"""Reading the JSON object out of a raw model response."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions.text import strip

# The think markers of reasoning models.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"


def strip_think(text: Column) -> Column:
    """Text after removing thought blocks.

    Closed blocks go; a block that never closes empties the text; after a closing marker
    without an opening one only what follows counts.
    """
    open_ = F.lit(THINK_OPEN)
    closed = F.regexp_replace(text, f"(?s){THINK_OPEN}.*?{THINK_CLOSE}", "")
    return (
        F.when(F.contains(closed, open_), "")
        .when(
            F.contains(closed, F.lit(THINK_CLOSE)),
            strip(F.substring_index(closed, THINK_CLOSE, -1)),
        )
        .otherwise(strip(closed))
    )


LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def _first_object(text: str | None, decoder: json.JSONDecoder) -> str | None:
    start = text.find("{") if text else -1
    while start >= 0:
        try:
            value, _ = decoder.raw_decode(text, start)
        except (ValueError, RecursionError):  # also a number of too many digits
            pass
        else:
            encoded = json.dumps(value, ensure_ascii=False)
            # Half of a surrogate pair is no text; such a response is no valid one.
            return None if LONE_SURROGATE.search(encoded) else encoded
        start = text.find("{", start + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first decodable JSON object inside each text, re-encoded; null if there is none."""
    decoder = json.JSONDecoder()
    return texts.map(lambda text: _first_object(text, decoder), na_action="ignore").astype(object)
