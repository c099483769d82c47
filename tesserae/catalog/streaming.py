"""Registered queries: streams over files that Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.catalog import fixtures as fx
from tesserae.catalog import sql
from tesserae.catalog.registry import query
from tesserae.runtime import scratch_path
from tesserae.streaming import jobs

_SCHEMA = "event_id bigint, ts string, case_id string, stage string, seconds double, output_tokens bigint"


def _arrivals(spark: SparkSession, sf: str) -> str:
    """Call records as JSON files; some records arrive twice."""
    path = scratch_path(spark, "arrivals")
    calls = fx.model_calls(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    calls.withColumn("_c", F.explode(twice)).drop("_c").repartition(4).write.json(path)
    return path


@query("st_profile", sql.using("model_calls", body="""
SELECT stage, count(*) AS calls, round(sum(seconds), 4) AS seconds, sum(output_tokens)::BIGINT AS output_tokens
FROM model_calls GROUP BY stage"""))
def st_profile(spark: SparkSession, sf: str) -> DataFrame:
    path, out = _arrivals(spark, sf), scratch_path(spark, "profile")
    stream = jobs.result_stream(spark, path, _SCHEMA)
    jobs.stream_profile(stream, "event_id", "stage", out, scratch_path(spark, "state")).awaitTermination()
    return jobs.read_latest(spark, out).select(
        "stage", "calls", F.round("seconds", 4).alias("seconds"), "output_tokens"
    )


@query("st_upsert", sql.using("model_calls", body="""
SELECT case_id, stage, arg_max(seconds, event_id) AS seconds, max(event_id) AS event_id
FROM model_calls GROUP BY case_id, stage"""))
def st_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest call per (case, stage), with every file as its own batch."""
    path, out = _arrivals(spark, sf), scratch_path(spark, "upserts")
    stream = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    # Batches come in any order, so the event number decides and not the arrival.
    keys = ["case_id", "stage"]
    jobs.stream_upsert(
        stream.select("case_id", "stage", "seconds", "event_id"), out,
        scratch_path(spark, "state"), keys, "event_id", buckets=16, late_wins=False,
    ).awaitTermination()
    return jobs.read_current(spark, out, keys, "event_id", late_wins=False)
