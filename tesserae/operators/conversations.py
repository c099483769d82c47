"""Conversations rendered to prompt texts in five separator styles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS_PER_PIECE = 64


@dataclass(frozen=True)
class Style:
    kind: str
    system: str
    sep: str
    sep2: str = ""


# Separators of the known templates.
STYLES = {
    "single": Style("SINGLE", "", "###"),
    "two": Style("TWO", "", " ", "</s>"),
    "mpt": Style("MPT", "", "<|im_end|>"),
    "llama_2": Style("LLAMA_2", "", "<s>", "</s>"),
    "plain": Style("PLAIN", "", "\n", "\n"),
}


def turn_text(style: Style, turn: Column, role: Column, text: Column) -> Column:
    """What one turn adds to the prompt; ``turn`` is its 0-based place."""
    even, spoken = turn % 2 == 0, F.coalesce(text, F.lit("")) != ""
    alternating = F.when(even, style.sep).otherwise(style.sep2)
    first = turn == 0
    if style.kind == "SINGLE":
        body = F.when(spoken, F.concat(role, F.lit(": "), text, F.lit(style.sep))).otherwise(
            F.concat(role, F.lit(":"))
        )
        return F.when(first, F.concat(F.lit(style.system + style.sep), body)).otherwise(body)
    if style.kind == "TWO":
        body = F.when(spoken, F.concat(role, F.lit(": "), text, alternating)).otherwise(
            F.concat(role, F.lit(":"))
        )
        return F.when(first, F.concat(F.lit(style.system + style.sep), body)).otherwise(body)
    if style.kind == "MPT":
        body = F.when(spoken, F.concat(role, text, F.lit(style.sep))).otherwise(role)
        return F.when(first, F.concat(F.lit(style.system + style.sep), body)).otherwise(body)
    if style.kind == "PLAIN":
        body = F.when(spoken, F.concat(text, alternating)).otherwise("")
        return F.when(first, F.concat(F.lit(style.system), body)).otherwise(body)
    if style.kind == "LLAMA_2":
        framed = F.when(
            first,
            F.concat(F.lit(f"<<SYS>>\n{style.system}\n<</SYS>>\n\n"), text),
        ).otherwise(text)
        asked = F.concat(F.lit("[INST] "), framed, F.lit(" [/INST]"))
        # The first separator is cut again, as a set of characters, at the very start.
        asked = F.when(first, asked).otherwise(F.concat(F.lit(style.sep), asked))
        told = F.concat(F.lit(" "), text, F.lit(" " + style.sep2))
        return F.when(~spoken, "").when(even, asked).otherwise(told)
    raise ValueError(f"unknown style {style.kind}")


def render_styles(
    turns: DataFrame, styles: dict[str, Style], keys: Sequence[str], piece: int = TURNS_PER_PIECE
) -> DataFrame:
    """(keys, style, turns, prompt): one prompt per conversation, all styles in one pass.

    ``turns`` has (keys, turn, role, text); ``turn`` is the 0-based place of a message. Turns
    are joined by pieces of a fixed number first, and the pieces then, so the turns of a long
    conversation don't meet one by one.
    """
    spoken = [
        F.struct(
            F.lit(name).alias("style"),
            turn_text(style, F.col("turn"), F.col("role"), F.col("text")).alias("said"),
        )
        for name, style in styles.items()
    ]
    said = turns.select(
        *keys,
        "turn",
        F.floor(F.col("turn") / piece).cast("bigint").alias("piece"),
        F.explode(F.array(*spoken)).alias("_s"),
    ).select(*keys, "turn", "piece", "_s.style", "_s.said")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "said")))
    pieces = said.groupBy(*keys, "style", "piece").agg(
        F.count("*").alias("turns"),
        F.array_join(F.transform(ordered, lambda entry: entry["said"]), "").alias("said"),
    )
    parts = F.array_sort(F.collect_list(F.struct("piece", "said")))
    return pieces.groupBy(*keys, "style").agg(
        F.sum("turns").alias("turns"),
        F.array_join(F.transform(parts, lambda entry: entry["said"]), "").alias("prompt"),
    )


def render_conversation(
    turns: DataFrame, style: Style, keys: Sequence[str], piece: int = TURNS_PER_PIECE
) -> DataFrame:
    """(keys, turns, prompt) in one style."""
    return render_styles(turns, {style.kind: style}, keys, piece).drop("style")


def first_turn_problems(turns: DataFrame, keys: Sequence[str], user_role: str) -> DataFrame:
    """Conversations that the LLAMA_2 style cannot start with."""
    bad = (F.coalesce(F.col("text"), F.lit("")) == "") | (F.col("role") != user_role)
    return turns.filter((F.col("turn") == 0) & bad).select(*keys)
