"""Content digests, derived ids and reproducible seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import json_list, json_string


def digest(canonical: Column) -> Column:
    """SHA-256 of an already canonical JSON text."""
    return F.sha2(canonical, 256)


def digest_list(*texts: Column) -> Column:
    return digest(json_list(*[json_string(text) for text in texts]))


def seeded_digest(seed: int, text: Column) -> Column:
    """Digest of the two-item list (seed, text); orders rows reproducibly."""
    return digest(json_list(F.lit(str(seed)), json_string(text)))


def unique_id(long_id: Column, question: Column) -> Column:
    return F.concat(long_id, F.lit("_"), F.substring(F.md5(question), 1, 8))


def sample_seed(seed: int, sample_id: Column, stage: Column) -> Column:
    """The first 32 bits of the digest of (seed, id, stage) as a number."""
    head = F.substring(
        digest(json_list(F.lit(str(seed)), json_string(sample_id), json_string(stage))), 1, 8
    )
    return F.conv(head, 16, 10).cast("bigint")
