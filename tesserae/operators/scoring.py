"""Accuracy of closed questions, exact match of open ones and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.choices import answer_label
from tesserae.functions.text import normalize_text
from tesserae.operators.joins import join_results

# Tasks that the published table reports as one group.
PAPER_GROUPS = {"ER": "Receptor", "PR": "Receptor", "HER2": "Receptor"}


def paper_group(task: Column) -> Column:
    group = task
    for name, target in PAPER_GROUPS.items():
        group = F.when(task == name, target).otherwise(group)
    return group


def group_keys(source: Column, task: Column) -> Column:
    """The overlapping groups that a closed question counts towards."""
    has_source, has_task = F.coalesce(source, F.lit("")) != "", F.coalesce(task, F.lit("")) != ""
    keys = F.array(
        F.lit("closed_overall"),
        F.when(has_source, F.concat(F.lit("source:"), source)),
        F.when(has_task, F.concat(F.lit("task:"), task)),
        F.when(has_task, F.concat(F.lit("paper_group:"), paper_group(task))),
    )
    return F.array_compact(keys)


def _percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / whole


def judged(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Closed manifest rows with the predicted label and whether it is right."""
    joined = join_results(manifest, results).filter(F.size("choices") > 0)
    predicted = F.when(F.col("valid"), answer_label(F.col("pred_answer"), F.col("choices")))
    return joined.withColumn("predicted_label", predicted).withColumn(
        "correct",
        F.coalesce(F.col("predicted_label") == F.col("ground_truth_label"), F.lit(False)),
    )


def score_closed(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(group, correct, total, accuracy_percent); missing and invalid answers are wrong.

    Rows are counted per (source, task) first. Only those few cells are then spread over
    the overlapping groups, so no question is ever duplicated.
    """
    cells = judged(manifest, results).groupBy("source", "task").agg(
        F.count_if("correct").alias("correct"), F.count("*").alias("total")
    )
    spread = cells.select(
        F.explode(group_keys(F.col("source"), F.col("task"))).alias("group"), "correct", "total"
    )
    return spread.groupBy("group").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total")
    ).withColumn("accuracy_percent", _percent(F.col("correct"), F.col("total")))


def score_counters(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """One row: expected, received, missing, invalid, complete."""
    counted = join_results(manifest, results).agg(
        F.count("*").alias("expected"),
        F.count_if("missing").alias("missing"),
        F.count_if("invalid").alias("invalid"),
    )
    return counted.select(
        "expected",
        (F.col("expected") - F.col("missing")).alias("received"),
        "missing",
        "invalid",
        (F.col("missing") == 0).alias("complete"),
    )


def open_pairs(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(sample_id, ground_truth, pred_answer) of the open questions."""
    return (
        join_results(manifest, results)
        .filter(F.size("choices") == 0)
        .select("sample_id", "ground_truth", "pred_answer")
    )


def score_open(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """One row: open questions and the share answered exactly; empty answers are wrong."""
    right = (F.col("pred_answer") != "") & (
        normalize_text(F.col("ground_truth")) == normalize_text(F.col("pred_answer"))
    )
    return (
        open_pairs(manifest, results)
        .agg(F.count("*").alias("total"), F.count_if(right).alias("_right"))
        .select("total", _percent(F.col("_right"), F.col("total")).alias("exact_match_percent"))
    )


def confusion(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Counts per task, right option text and predicted option text ('' if unclear)."""
    def text(label: str) -> Column:
        return F.get(F.filter("choices", lambda entry: entry.label == F.col(label)), F.lit(0)).text

    return (
        judged(manifest, results)
        .select(
            "task",
            text("ground_truth_label").alias("truth"),
            F.coalesce(text("predicted_label"), F.lit("")).alias("predicted"),
        )
        .groupBy("task", "truth", "predicted")
        .agg(F.count("*").alias("questions"))
    )


def class_recall(confusion_table: DataFrame) -> DataFrame:
    right = F.col("truth") == F.col("predicted")
    return (
        confusion_table.groupBy("task", "truth")
        .agg(
            F.coalesce(F.sum(F.when(right, F.col("questions"))), F.lit(0)).alias("hits"),
            F.sum("questions").alias("support"),
        )
        .withColumn("recall_percent", _percent(F.col("hits"), F.col("support")))
    )


def balanced_accuracy(confusion_table: DataFrame) -> DataFrame:
    return class_recall(confusion_table).groupBy("task").agg(
        F.count("*").alias("classes"), F.avg("recall_percent").alias("balanced_accuracy_percent")
    )


def compare_runs(manifest: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Per task: questions fixed, broken, right in both and wrong in both runs."""
    a = judged(manifest, first).select("sample_id", "task", F.col("correct").alias("_a"))
    b = judged(manifest, second).select("sample_id", F.col("correct").alias("_b"))
    a_right, b_right = F.col("_a"), F.col("_b")
    return (
        a.join(b, "sample_id")
        .groupBy("task")
        .agg(
            F.count_if(~a_right & b_right).alias("fixed"),
            F.count_if(a_right & ~b_right).alias("broken"),
            F.count_if(a_right & b_right).alias("both_right"),
            F.count_if(~a_right & ~b_right).alias("both_wrong"),
        )
    )


def transitions(manifest: DataFrame, predicted: DataFrame, final: DataFrame) -> DataFrame:
    """How the last answer relates to the first one: counts per (from, to) verdict."""
    def verdict(df: DataFrame, name: str) -> DataFrame:
        word = (
            F.when(F.col("correct"), "right")
            .when(F.col("predicted_label").isNull(), "none")
            .otherwise("wrong")
        )
        return judged(manifest, df).select("sample_id", word.alias(name))

    return (
        verdict(predicted, "from_state")
        .join(verdict(final, "to_state"), "sample_id")
        .groupBy("from_state", "to_state")
        .agg(F.count("*").alias("questions"))
    )
