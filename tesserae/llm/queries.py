"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import (
    backoff,
    bitsliced,
    bm25,
    credentials,
    importance,
    langid,
    mixing,
    packing,
    periodic,
    permutation,
    sharding,
    simhash,
    transducer,
)
from tesserae.llm.common import crc_bucket
from tesserae.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per_source),
candidates AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
  FROM weighed),
rates AS (
  SELECT source, source_size, least(most, max(candidate) OVER () * weight) AS target FROM candidates),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies,
       (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size AS taken
FROM drawn
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


SHARD_SQL = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
depths AS (SELECT unnest(range(0, 41))::BIGINT AS depth),
buckets AS (
  SELECT depth, place >> (60 - depth) AS bucket, sum(bytes) AS total, count(*) AS rows
  FROM sized, depths GROUP BY 1, 2),
fits AS (SELECT * FROM buckets WHERE total <= {sharding.LIMIT_BYTES} OR rows = 1),
leaves AS (
  SELECT s.doc_id, s.bytes, s.place, min(f.depth) AS depth
  FROM sized s, depths d, fits f
  WHERE f.depth = d.depth AND f.bucket = s.place >> (60 - d.depth)
  GROUP BY 1, 2, 3)
SELECT doc_id, bytes, depth, 0::BIGINT AS page,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(place >> (60 - depth)), depth::INT, '0') END AS shard
FROM leaves
"""


@query("op9_extendible_shards", SHARD_SQL)
def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    labelled = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    models = langid.train(labelled.withColumnRenamed("doc_id", "key"))
    found = langid.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "__lang.*")


@query("op7_backoff_scores")
def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return backoff.score_documents(docs, crc_bucket(F.col("doc_id"), 7) == 2)


def pack_with_public_tokenizer(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(
        docs,
        str(public_tokenizers.path("byte_bpe_50k.json")),
        str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        public_tokenizers.PATTERN,
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_tokenizer(table(spark, sf_dir, "documents"))


@query("op3_permutation_index")
def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.nearest(vectors, F.col("vec_id") % 20 == 0)


@query("op8_transducer_counts")
def op8_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    counted = transducer.count_tokens(table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > transducer.LIMIT_TOKENS)


@query("op1_importance_resampling")
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance.resample(docs, table(spark, sf_dir, "labels"))


BM25_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id AS query_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+')) AS term
  FROM benchmark),
terms AS (SELECT query_id, term, count(*) AS repeats FROM asked GROUP BY 1, 2),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY 1, 2),
lengths AS (
  SELECT d.doc_id, coalesce(w.n, 0) AS n
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY 1) w USING (doc_id)),
total AS (SELECT count(*) AS docs, sum(n)::DOUBLE / count(*) AS mean FROM lengths),
weights AS (
  SELECT term, ln(1 + (t.docs - c.df + 0.5::DOUBLE) / (c.df + 0.5::DOUBLE)) AS idf
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY 1) c, total t),
scored AS (
  SELECT q.query_id, c.doc_id,
         sum(round(q.repeats * w.idf * c.tf * ({bm25.K1}::DOUBLE + 1)
             / (c.tf + {bm25.K1}::DOUBLE * (1 - {bm25.B}::DOUBLE + {bm25.B}::DOUBLE * l.n / t.mean))
             / 1e-6::DOUBLE)::BIGINT)::BIGINT AS units
  FROM terms q JOIN counts c USING (term) JOIN weights w USING (term)
       JOIN lengths l USING (doc_id), total t
  GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank
  FROM scored WHERE units > 0)
SELECT query_id, rank, doc_id, units * 1e-6::DOUBLE AS score FROM ranked WHERE rank <= {bm25.K}
"""


@query("op4_block_max_search", BM25_SQL)
def op4_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.build_index(table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return bm25.search(asked, index)


#: The same search, asked by whole documents.
DOCUMENT_SEARCH_SQL = BM25_SQL.replace("SELECT item_id AS query_id", "SELECT doc_id AS query_id").replace(
    "FROM benchmark)", "FROM documents WHERE doc_id % 20 = 0)"
)


@query("op4_document_search", DOCUMENT_SEARCH_SQL)
def op4_document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(asked, bm25.build_index(docs))


RESAMPLING_SQL = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           list_prepend(i, range(8)),
           lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
texts AS (
  SELECT true AS raw, doc_id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT false, NULL, NULL, text FROM benchmark),
found AS (
  SELECT raw, row, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
counted AS (SELECT raw, row, word, count(*) AS n FROM found GROUP BY ALL),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(strlen(word)),
             lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % {bitsliced.BUCKETS} AS bucket
  FROM (SELECT DISTINCT word FROM counted), bits),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((sums.t + 1)::DOUBLE * (total.s + {bitsliced.BUCKETS})::DOUBLE
           / ((sums.s + 1)::DOUBLE * (total.t + {bitsliced.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM sums, total),
summed AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS gain
  FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY 1),
weighed AS (
  SELECT doc_id, row, coalesce(n_features, 0) AS n_features,
         CASE WHEN n_features > 0 THEN (gain - ((gain % n_features) + n_features) % n_features) // n_features
              ELSE 0 END AS weight,
         ('0x' || substr(sha256('{bitsliced.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN summed USING (row) WHERE raw),
scored AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank,
         count(*) OVER () AS n
  FROM scored WHERE n_features >= {bitsliced.LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
       CASE WHEN rank <= {bitsliced.PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""


@query("op12_bitsliced_resampling", RESAMPLING_SQL)
def op12_bitsliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bitsliced.resample(docs, table(spark, sf_dir, "benchmark")).drop("n_words")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, whose tail repeats if the hash of its id says so."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    tail = words[at : at + period] * -(-(n - at) // period)
    return words[:at] + tail[: n - at]


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    longest = F.array_min(F.expr("transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period))"))
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    found = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _credential_scan(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT row, '{name}' AS scan, regexp_extract_all(text, '{quoted}') AS m,\n"
        f"       string_split_regex(text, '{quoted}') AS g FROM texts"
    )


CREDENTIAL_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
scans AS (
{" UNION ALL ".join(_credential_scan(n, p) for n, p in [*credentials.PATTERNS.items(), ("break", credentials.BLANK_LINE)])}),
listed AS (
  SELECT row, scan, unnest(m) AS m, unnest(g[:len(m)]) AS g, generate_subscripts(m, 1) AS i
  FROM scans WHERE len(m) > 0),
placed AS (
  SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY row, scan ORDER BY i)::BIGINT AS stop FROM listed),
valued AS (
  SELECT row, scan, m, stop - length(m) AS start, stop,
         length(regexp_extract(m, '{credentials.PATTERNS["assign"].replace("'", "''")}', 1)) AS value
  FROM placed),
parts AS (
  SELECT row, start, stop,
         CASE scan
         WHEN 'assign' THEN CASE WHEN value >= {credentials.LONG_VALUE} THEN 0 WHEN value >= {credentials.SHORT_VALUE} THEN 3 END
         WHEN 'access' THEN CASE WHEN length(m) >= {credentials.LONG_ACCESS} THEN 1
                                 WHEN length(m) >= {credentials.SHORT_ACCESS} THEN 5 END
         WHEN 'hex' THEN CASE WHEN length(m) >= {credentials.LONG_HEX} THEN 2
                              WHEN regexp_matches(m, '[a-f]') AND regexp_matches(m, '[0-9]') THEN 6 END
         WHEN 'account' THEN 4 WHEN 'endpoint' THEN 7 END AS kind
  FROM valued),
roles AS (SELECT *, {credentials.ROLES}[kind + 1] AS role FROM parts WHERE kind IS NOT NULL),
reported AS (
  SELECT * FROM roles a
  WHERE kind < {credentials.STRONG} OR EXISTS (
    SELECT 1 FROM roles b
    WHERE b.row = a.row AND (a.role = 'secret') <> (b.role = 'secret')
      AND greatest(a.start, b.start) >= least(a.stop, b.stop)
      AND greatest(a.start, b.start) - least(a.stop, b.stop) <= {credentials.SCOPE}
      AND NOT EXISTS (
        SELECT 1 FROM valued v
        WHERE v.row = a.row AND v.scan = 'break'
          AND v.start >= least(a.stop, b.stop) AND v.stop <= greatest(a.start, b.start)))),
labelled AS (
  SELECT row, start, kind, {credentials.KINDS}[kind + 1] || ':' || start || ':' || stop AS span FROM reported),
summed AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {credentials.STRONG}), '') AS base,
         string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM labelled GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (row)
"""


@query("op11_credential_links", CREDENTIAL_SQL)
def op11_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < credentials.STRONG)
    counts = [
        F.expr(f"CAST(size(filter(spans, s -> s.kind = {kind})) AS BIGINT) AS n_{credentials.KINDS[kind]}")
        for kind in range(credentials.STRONG)
    ]
    digest = F.sha2(credentials.span_text(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, credentials.span_text(F.col("spans")).alias("spans"))
