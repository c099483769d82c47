"""File listings, content hashes and keyed extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of image files, compared without regard to case.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".svs", ".ndpi", ".mrxs")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size) of all files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size"))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\A.+(\.[^.]*)\z", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)(\A.+)\.[^.]*\z", "$1")


def image_index(listing: DataFrame) -> DataFrame:
    """(image_id, path) of the image files, image id being the file name without suffix."""
    return listing.filter(suffix(F.col("path")).isin(*IMAGE_SUFFIXES)).select(
        stem(F.col("path")).alias("image_id"), "path"
    )


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, content); for files up to the 2 GB limit of a binary cell."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.col("length").alias("size"), "content")
    )


def hash_files(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Size, SHA-256 and MD5 of every file; with ``expected`` also a verdict per file.

    ``expected`` has (path, want_sha256, want_size). Contents are hashed before the join,
    so only digests are shuffled. ``status``: ok, mismatch, missing or unexpected.
    """
    hashed = files.select(
        "path",
        F.col("size").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("md5"),
    )
    if expected is None:
        return hashed
    same = (F.col("sha256") == F.col("want_sha256")) & (F.col("size") == F.col("want_size"))
    return hashed.join(expected, "path", "full").select(
        "path",
        "size",
        "sha256",
        "md5",
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("want_sha256").isNull(), "unexpected")
        .when(same, "ok")
        .otherwise("mismatch")
        .alias("status"),
    )


def extract_by_key(
    payloads: DataFrame, mapping: DataFrame, present: DataFrame, key: str, payload: str
) -> DataFrame:
    """What happened to every wanted key: (key, name, original, status, content_sha256).

    ``mapping`` (key, name, original) drives a join against the payload table, whose scan
    the optimiser can prune by the wanted keys. ``present`` (name) needs no extraction.
    ``status``: restored, already_present, missing, duplicate or empty.
    """
    wanted = mapping.join(
        present.select("name").distinct().withColumn("_here", F.lit(True)), "name", "left"
    )
    hits = payloads.join(mapping.select(key), key, "left_semi")
    found = hits.groupBy(key).agg(
        F.count("*").alias("_n"),
        F.max(F.length(payload)).alias("_size"),
        F.max(F.sha2(F.col(payload).cast("binary"), 256)).alias("_sha"),
    )
    status = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.col("_here").isNotNull(), "already_present")
        .when(F.coalesce(F.col("_size"), F.lit(0)) == 0, "empty")
        .otherwise("restored")
    )
    return wanted.join(found, key, "left").select(
        key,
        "name",
        "original",
        status.alias("status"),
        F.when(status == "restored", F.col("_sha")).alias("content_sha256"),
    )


def unsafe_or_ambiguous(mapping: DataFrame, key: str) -> DataFrame:
    """Wanted keys that stand for two images, or whose image name has a folder part."""
    unsafe = F.contains(F.col("name"), F.lit("/"))
    return (
        mapping.groupBy(key)
        .agg(
            F.min(F.struct("name", "original")).alias("_low"),
            F.max(F.struct("name", "original")).alias("_high"),
            F.bool_or(unsafe).alias("unsafe"),
        )
        .filter((F.col("_low") != F.col("_high")) | F.col("unsafe"))
        .select(key, "unsafe")
    )


def extract_links(
    pages: DataFrame, page: str, html: str, pattern: str = r'href="([^"]*)"'
) -> DataFrame:
    """(page, position, url): links in document order, positions from 0."""
    urls = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(page, F.posexplode(urls).alias("position", "url"))


def pick_links(links: DataFrame, wanted: DataFrame, page: str) -> DataFrame:
    """The url at a 1-based position per wanted row, null when the page has too few."""
    at = links.select(page, (F.col("position") + 1).alias("position"), "url")
    return wanted.join(at, [page, "position"], "left")


def indexed_links(pages: DataFrame, page: str, html: str, pattern: str) -> DataFrame:
    """(page, index, url, urls): the links that the markup itself numbers, from a pattern of two groups
    (index, url). An index with several different urls is a conflict: its url is null and ``urls``
    tells how many there are."""
    found = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1)).alias("index"),
        F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(2)).alias("url"),
    )
    links = pages.select(page, F.explode(F.array_distinct(found)).alias("_l"))
    links = links.select(page, F.col("_l.index").try_cast("bigint").alias("index"), F.col("_l.url").alias("url"))
    counted = links.groupBy(page, "index").agg(F.count_distinct("url").alias("urls"), F.min("url").alias("url"))
    return counted.select(page, "index", F.when(F.col("urls") == 1, F.col("url")).alias("url"), "urls")


def pick_indexed(links: DataFrame, wanted: DataFrame, page: str) -> DataFrame:
    """``wanted`` (page, position from 1) with url and status: found, missing, or conflict where the page
    contradicts itself at any index, as then none of its links can be trusted."""
    pages = links.groupBy(page).agg(F.count("*").alias("exposed"), F.count_if(F.col("urls") > 1).alias("_bad"))
    at = links.select(page, (F.col("index") + 1).alias("position"), "url")
    joined = wanted.join(pages, page, "left").join(at, [page, "position"], "left")
    conflict = F.coalesce(F.col("_bad") > 0, F.lit(False))
    status = F.when(conflict, "conflict").when(F.col("url").isNull(), "missing").otherwise("found")
    return joined.select(
        *wanted.columns, F.when(~conflict, F.col("url")).alias("url"), status.alias("status"),
        F.coalesce("exposed", F.lit(0)).alias("exposed"),
    )
