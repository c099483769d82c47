"""Corpus pipeline: quality, language, near-duplicates, mixing and packing.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. ``quality``: importance resampling with the labels of ``labels``; what is not sampled goes.
2. ``language``: documents that the language models reject go: those without letters, and those
   far from every learned language.
3. ``near_duplicates``: SimHash links that hold on the texts, and all other links of similar shingle
   sets; of each component the document of least id stays, one row of it if rows repeat.
   Exact copies meet by a hash of the text; links are found by ``tesserae.llm.simhash`` and
   ``tesserae.llm.shared_shingles``.
4. ``mixing``: documents repeat or go by the rates of their sources; copies are repeated rows.
5. ``packing``: pieces of token sequences; a repeated row is packed as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import importance, langid, mixing, simhash
from tesserae.llm.common import written
from tesserae.llm.queries import pack_with_public_tokenizer
from tesserae.runtime import table


#: Texts go to Python in batches of at most so many bytes. Spark's own limit of 64 MB is held by
#: the JVM and by Python several times over, for each task of an executor.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of a batch; one that is lower already stays."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return importance.select_documents(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    models = langid.train(labelled.select(F.col("doc_id").alias("key"), "lang", "text"))
    found = langid.identify(docs, models)
    return found.filter(~F.col("__lang.rejected")).drop("__lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_with_public_tokenizer(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The models of the first two stages and the tokenizer can't be expressed in SQL; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
