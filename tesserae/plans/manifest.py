"""Annotations to a verified manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tesserae.operators.joins import resolve_images
from tesserae.operators.samples import check_expected, validate
from tesserae.runtime import require_empty
from tesserae.sources.manifest import write_manifest


def build_manifest(
    samples: DataFrame,
    path: str,
    index: DataFrame | None = None,
    expected_questions: int | None = None,
    expected_images: int | None = None,
    strict: bool = True,
    **metadata: str,
) -> DataFrame:
    """Validate, resolve images, compare counts and write; returns the rejected rows."""
    good, rejected = validate(samples)
    if index is not None:
        resolved = resolve_images(good, index)
        lost = resolved.filter("n_paths <> 1")
        if strict:
            require_empty(lost, "image not found exactly once")
        good = resolved.filter("n_paths = 1").withColumn("image_path", resolved["path"]).select(
            *good.columns
        )
    if strict:
        require_empty(rejected, "rejected question")
    counts = check_expected(good, expected_questions, expected_images)
    require_empty(counts.filter("NOT ok"), "unexpected release size")
    write_manifest(good, path, **metadata)
    return rejected
