"""Result files of all shards to accuracy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tesserae.operators.joins import outside_manifest
from tesserae.operators.scoring import open_pairs, score_closed, score_counters, score_open
from tesserae.operators.textmetrics import bleu, cider, rouge_l
from tesserae.runtime import require_empty
from tesserae.sources.results import checked_results


@dataclass(frozen=True)
class Metrics:
    counters: DataFrame
    closed: DataFrame
    open: DataFrame
    text: dict[str, DataFrame]


def evaluate(
    manifest: DataFrame, results: DataFrame, locks: DataFrame, text_metrics: bool = False
) -> Metrics:
    """Score against the whole manifest; results outside of it are refused."""
    results = checked_results(results, locks)
    require_empty(outside_manifest(manifest, results), "result outside the manifest")
    text: dict[str, DataFrame] = {}
    if text_metrics:
        pairs = open_pairs(manifest, results)
        names = {"row_id": "sample_id", "ref": "ground_truth", "hyp": "pred_answer"}
        text = {
            "bleu": bleu(pairs, **names),
            "rouge_l": rouge_l(pairs, **names),
            "cider": cider(pairs, **names),
        }
    return Metrics(
        score_counters(manifest, results),
        score_closed(manifest, results),
        score_open(manifest, results),
        text,
    )
