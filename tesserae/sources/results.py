"""Result files of many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.joins import check_identity
from tesserae.operators.sets import find_duplicates
from tesserae.runtime import require_empty

RESULT_SCHEMA = "sample_id string, status string, pred_answer string, run_hash string"


def run_of(path: Column) -> Column:
    """Run of ``…/<run>/results/[start=…/]<file>``, or of ``…/results/run=<run>/<file>``."""
    folder = F.regexp_extract(path, r"/([^/]+)/[^/]+\z", 1)
    named = F.regexp_extract(path, r"([^/]+)/results/(?:start=[^/]+/)?[^/]+\z", 1)
    return F.when(folder.startswith("run="), F.substring(folder, 5, 1 << 30)).otherwise(named)


def read_results(spark: SparkSession, root: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """All result rows below ``root/*/results`` with their run."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .json(f"{root}/*/results")
        .withColumn("run", run_of(F.col("_metadata.file_path")))
    )


def write_results(results: DataFrame, root: str, run: str) -> None:
    results.write.mode("append").json(f"{root}/{run}/results")


def write_run_results(results: DataFrame, root: str) -> None:
    """Results of many runs (column ``run``: letters, digits, ``-`` and ``_``) in one job."""
    results.write.mode("append").partitionBy("run").json(f"{root}/runs/results")


def checked_results(results: DataFrame, locks: DataFrame) -> DataFrame:
    """Results, after refusing repeated ids, foreign run hashes and mixed runs."""
    require_empty(find_duplicates(results, ["sample_id"]), "repeated result")
    identity = check_identity(results, locks)
    require_empty(
        identity.filter("mismatched > 0 OR NOT one_config OR NOT one_code"), "run identity"
    )
    return results
