"""SimHash near-duplicates through deletion-variant signatures.

Two fingerprints that differ in at most ``max_bits`` (0 to 3) bits agree, up to one bit, on one
of their two 32-bit halves. Every distinct fingerprint is therefore indexed under 64 signatures:
a half with one bit position taken out. Fingerprints meet by equality of signatures and are
then verified on all 64 bits. A bucket of more than ``bucket_limit`` fingerprints is cut again in
the same way along the bits that its signature leaves open, so no bucket of any size is compared
pair by pair and no link is lost. From a bucket come only links that span its classes, never
all its pairs.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a
fingerprint. A null id takes no part in a component's least id; a component of null ids only
has component_id null. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch, small, word_runs, written
from tesserae.llm.graph import components
from tesserae.llm.shared_shingles import similar_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET_LIMIT = 2048
#: With so few bits open, a bucket has at most 2,048 fingerprints: these bits and the three
#: that were taken out on the way.
OPEN_BITS = 8
SIGNATURES = 64
SIGNATURES_A_TASK = 500_000
HASHES_AT_ONCE = 1 << 16


def _bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[start : start + HASHES_AT_ONCE], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingle hashes; as a signed 64-bit number."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest
    for run in word_runs(text, keep=width - 1):
        if len(run) < width:
            shingles = [b" ".join(run)]
        elif width == 1:
            shingles = run
        else:
            shingles = map(b" ".join, zip(*(run[i:] for i in range(width)), strict=False))
        hashes = [digest(s, seed) for s in shingles]
        counts += _bit_counts(hashes)
        n += len(hashes)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, width: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("bigint")
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width, seed) for t in texts], dtype="int64")

    return of_texts(text)


def _variants(members: DataFrame) -> DataFrame:
    """Signatures of members (view, fp, mask, lo, width): cut the open bits [lo, lo + width)
    into two halves; a signature fixes one half but for one bit, the other half stays open."""
    half = "(width div 2)"
    cuts = F.expr(
        f"explode(transform(sequence(0, 2 * {half} - 1), i -> named_struct("
        f"'mask', mask | (shiftleft(CASE WHEN {half} = 32 THEN 4294967295L "
        f"ELSE shiftleft(1L, {half}) - 1 END, lo + (i div {half}) * {half}) & ~shiftleft(1L, lo + i)), "
        f"'lo', IF(i < {half}, lo + {half}, lo))))"
    )
    return members.select("view", "fp", F.expr(f"CAST({half} AS INT)").alias("width"), cuts.alias("cut")).select(
        "view",
        "fp",
        F.col("cut.mask").alias("mask"),
        F.expr("fp & cut.mask").alias("value"),
        F.col("cut.lo").cast("int").alias("lo"),
        "width",
    )


def _spanning(found: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the classes of fingerprints within ``max_bits`` of each other."""
    values = found.view(np.uint64)
    left = np.arange(len(values))
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= max_bits
            links += [(int(found[at]), int(found[other])) for other in left[near]]
            queue.extend(left[near])
            left = left[~near]
    return links


def _bucket_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = [
                (view, *link)
                for view, members in zip(batch["view"], batch["members"], strict=True)
                for link in _spanning(np.asarray(members, dtype=np.int64), max_bits)
            ]
            if links:
                yield pd.DataFrame(links, columns=["view", "a", "b"])

    return buckets.select("view", "members").mapInPandas(scan, "view int, a bigint, b bigint")


def links(
    fps: DataFrame,
    max_bits: int = MAX_BITS,
    bucket_limit: int = BUCKET_LIMIT,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Links (view, a, b) between fingerprints of a written table of distinct (view, fp).

    Their classes are those of all pairs within ``max_bits``, at any ``bucket_limit``. With ``scratch``
    the tables of the way, which the links still read, can be deleted later.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves only find all links of up to three differing bits")
    written = (scratch or Scratch(fps.sparkSession)).written
    keys = ["view", "mask", "value"]
    parts = -(-(fps.count() + 1) * SIGNATURES // SIGNATURES_A_TASK)
    members = fps.repartition(parts).select(
        "view", "fp", F.lit(0).cast("bigint").alias("mask"), F.lit(0).alias("lo"), F.lit(64).alias("width")
    )
    found, open_bits = None, 32
    while True:
        signed = _variants(members)
        buckets = signed.groupBy(*keys).agg(
            F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
        )
        shared = written(buckets.filter("n > 1"), "buckets")
        pairs = shared.filter(f"n = 2 and bit_count(a ^ b) <= {max_bits}").select("view", "a", "b")
        bounded = F.lit(open_bits <= OPEN_BITS) | (F.col("n") <= bucket_limit)
        several = small(shared.filter((F.col("n") > 2) & bounded).select(*keys))
        gathered = signed.join(several, keys).groupBy(*keys).agg(F.collect_list("fp").alias("members"))
        part = pairs.unionByName(_bucket_links(gathered, max_bits))
        found = part if found is None else found.unionByName(part)
        large = shared.filter(~bounded).select(*keys)
        if not large.take(1):
            return found.distinct()
        columns = ["view", "fp", "mask", "lo", "width"]
        members = written(signed.join(large, keys).select(*columns).distinct(), "hot")
        open_bits //= 2


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """(doc_id, fp, component_id) of documents (doc_id, text)."""
    hashed = docs.select("doc_id", fingerprints(F.col("text"), width, seed).alias("fp"))
    hashed = written(hashed, "fingerprints")
    fps = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(fps.select(F.lit(0).alias("view"), "fp"), max_bits, bucket_limit)
    rooted = fps.join(components(found), fps["fp"] == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    classes = written(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "classes")
    return hashed.join(classes, "fp").select("doc_id", "fp", "component_id")


def _linked_texts(nodes: DataFrame, max_bits: int, bucket_limit: int, scratch: Scratch) -> DataFrame:
    """(a, b) of texts (node, fp) that SimHash links; a fingerprint stands for its least node."""
    fps = scratch.written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fps")
    found = links(fps.select(F.lit(0).alias("view"), "fp"), max_bits, bucket_limit, scratch)
    for end in ("a", "b"):
        named = fps.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}"))
        found = found.join(named, end)
    same = nodes.join(fps, "fp").filter("node <> least").select(F.col("node").alias("node_a"), F.col("least").alias("node_b"))
    both = found.select("node_a", "node_b").unionByName(same)
    ends = F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    return scratch.written(both.select(*ends).distinct(), "linked")


def drop_near_duplicates(
    docs: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    bucket_limit: int = BUCKET_LIMIT,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` without near copies: of each component the row of least id stays.

    Texts are linked if their shingles of ``width`` words have a Jaccard similarity of at least
    ``similarity``. What SimHash links, as :func:`near_duplicates` does, is verified on the texts first;
    fingerprints lose some links and make some that are none, so ``shared_shingles`` finds all others.
    Equal texts are one node, named by a 64-bit hash. A null id comes last; of repeated rows one stays.
    """
    scratch = Scratch(docs.sparkSession)
    node = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keyed = scratch.written(docs.select("doc_id", node.alias("node"), fingerprints(F.col("text")).alias("fp")), "keyed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    nodes = scratch.written(keyed.groupBy("node").agg(F.min(order).alias("least"), F.min("fp").alias("fp")), "nodes")
    linked = _linked_texts(nodes.select("node", "fp"), max_bits, bucket_limit, scratch)
    texts = docs.select(node.alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    roots = similar_components(texts, width, similarity, bucket_limit, scratch, linked)
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = scratch.written(rooted, "rooted")
    keepers = rooted.groupBy("root").agg(F.min("least").alias("keeper")).select(F.col("keeper.node").alias("node"), F.col("keeper.doc_id").alias("kept"))
    keepers = scratch.written(keepers, "keepers")
    marked = keyed.select("doc_id", "node").join(keepers.withColumn("__keeps", F.lit(True)), "node", "left")
    stays = F.col("__keeps").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept"))
    ids = marked.groupBy("doc_id", "node").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    ids = written(ids, "decisions")
    gone = small(written(ids.filter("not stays").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")), "gone"))
    scratch.clear()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (node == F.col("__node")), "left_anti")
    repeated = ids.filter("stays and rows > 1").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
    if not repeated.take(1):
        return kept
    repeated = small(repeated)
    is_one = docs["doc_id"].eqNullSafe(F.col("__id")) & (node == F.col("__node"))
    once = kept.join(repeated, is_one, "left_semi").withColumn("__node", node)
    once = once.dropDuplicates(["doc_id", "__node"]).drop("__node")
    return kept.join(repeated, is_one, "left_anti").unionByName(once)
