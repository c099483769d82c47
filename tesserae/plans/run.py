"""A run of the agent that can be stopped and started again.

Everything of a run is below one folder: a lock with the identity, the results of every start, and
the calls. A start only works on questions without a final result, and refuses a folder whose
lock names another configuration, code or manifest. Each start appends folders of its own, numbered
after the committed ones; a start that broke off has committed whole batches or nothing of them,
and its number is used again. Two starts at the same time are not supported.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.prompts import is_terminal
from tesserae.plans.agent import AgentParams, run_agent
from tesserae.plans.backend import Backend
from tesserae.plans.calls import CallLog
from tesserae.runtime import require_empty

RESULTS = (
    "query_id bigint, image_id string, pred_answer string, explanation string, status string, stop_reason string, "
    "iterations bigint, initial_region_count bigint, total_examined_regions bigint, run_hash string, protocol string, "
    "start bigint"
)


@dataclass(frozen=True)
class RunIdentity:
    config_hash: str
    code_hash: str
    manifest_hash: str

    @property
    def run_hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that a job has finished writing."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return sorted(n for n in names if _exists(spark, f"{path}/{n}/_SUCCESS"))


def open_run(spark: SparkSession, root: str, run: str, identity: RunIdentity) -> str:
    """The run's hash, after writing its lock or comparing with the one that is there."""
    lock = f"{root}/{run}/run_lock"
    row = {"run": run, "lock_hash": identity.run_hash, **asdict(identity)}
    schema = ", ".join(f"{name} string" for name in row)
    if "run_lock" in committed(spark, f"{root}/{run}"):
        found = spark.read.schema(schema).json(lock).first().asDict()
        changed = sorted(name for name, value in asdict(identity).items() if found[name] != value)
        if found["lock_hash"] != identity.run_hash:
            raise ValueError(f"resume refused, changed: {', '.join(changed)}")
    else:
        spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("overwrite").json(lock)
    return identity.run_hash


def read_locks(spark: SparkSession, root: str) -> DataFrame:
    """(run, lock_hash, config_hash, code_hash) of all runs below ``root``."""
    schema = "run string, lock_hash string, config_hash string, code_hash string"
    return spark.read.schema(schema).json(f"{root}/*/run_lock")


def stored_results(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The last result of every question, over all starts."""
    path = f"{root}/{run}/results"
    names = committed(spark, path)
    if not names:
        return spark.createDataFrame([], RESULTS)
    rows = spark.read.schema(RESULTS).json([f"{path}/{name}" for name in names])
    columns = [field.split(" ")[0] for field in RESULTS.split(", ")]
    last = rows.groupBy("query_id").agg(F.max_by(F.struct(*columns[1:]), "start").alias("_last"))
    return last.select("query_id", "_last.*")


def run_inference(
    spark: SparkSession,
    samples: DataFrame,
    regions: DataFrame,
    backend: Callable[[CallLog], Backend],
    root: str,
    run: str,
    identity: RunIdentity,
    protocol: str,
    params: AgentParams = AgentParams(),
    batches: int = 1,
) -> DataFrame:
    """Answer the questions that have no final result yet; returns the results of all starts.

    Questions are worked on in ``batches`` by image, and each batch is stored before the next one
    starts. ``backend`` makes the backend around the log of a batch.
    """
    run_hash = open_run(spark, root, run, identity)
    require_empty(stored_results(spark, root, run).filter(F.col("run_hash") != run_hash), "result of another run")
    path = f"{root}/{run}/results"
    start = 1 + max((int(name.split("=")[1].split("-")[0]) for name in committed(spark, path)), default=0)
    for batch in range(batches):
        stored = stored_results(spark, root, run)
        final = stored.filter(is_terminal(protocol, F.col("status"))).select("query_id")
        mine = F.pmod(F.xxhash64("image_id"), F.lit(batches)) == batch
        work = samples.filter(mine).join(final, "query_id", "left_anti")
        if not work.take(1):
            continue
        name = f"start={start:04d}-{batch:04d}"
        results = run_agent(work, regions, backend(CallLog(f"{root}/{run}/calls/{name}")), params).results
        kept = results.withColumns(
            {"run_hash": F.lit(run_hash), "protocol": F.lit(protocol), "start": F.lit(start).cast("bigint")}
        )
        kept.write.mode("overwrite").json(f"{path}/{name}")
    return stored_results(spark, root, run)


def stored_calls(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The calls of all committed batches: those of a start that broke off before storing its
    results have no results either."""
    path = f"{root}/{run}/calls"
    names = [n for n in committed(spark, f"{root}/{run}/results") if _exists(spark, f"{path}/{n}")]
    parts = [CallLog(f"{path}/{name}").read(spark).withColumn("start", F.lit(name)) for name in names]
    if not parts:
        return CallLog().read(spark).withColumn("start", F.lit(None).cast("string"))
    calls = parts[0]
    for part in parts[1:]:
        calls = calls.unionByName(part)
    return calls
