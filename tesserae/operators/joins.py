"""Joins that match questions, images, files, archives and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.geometry import slide_of
from tesserae.functions.prompts import is_terminal


def resolve_images(samples: DataFrame, index: DataFrame, key: str = "image_id") -> DataFrame:
    """Samples with their one image; ``n_paths`` other than 1 marks an error row.

    ``index`` has (key, path). Paths are counted before the join, so that a name with very
    many files adds one row and not one per file.
    """
    counted = index.groupBy(key).agg(
        F.count("*").alias("n_paths"), F.min("path").alias("_path")
    )
    n_paths = F.coalesce(F.col("n_paths"), F.lit(0)).cast("bigint")
    return samples.join(counted, key, "left").select(
        *samples.columns,
        n_paths.alias("n_paths"),
        F.when(n_paths == 1, F.col("_path")).alias("path"),
    )


def map_cases(
    samples: DataFrame, slide_map: DataFrame, image_root: str, require: bool = False
) -> DataFrame:
    """Case questions with their slide through an explicit (case_id, slide_file) map.

    An unmapped case keeps its case id and an empty path, or is marked ``unmapped`` as an
    error when images are required.
    """
    base = F.substring_index(F.col("slide_file"), "/", -1)
    stem = F.regexp_replace(base, r"(?s)(\A.+)\.[^.]*\z", "$1")
    missing = F.col("slide_file").isNull()
    return samples.join(slide_map, "case_id", "left").select(
        *samples.columns,
        F.when(missing, F.col("case_id")).otherwise(stem).alias("image_id"),
        F.when(missing, "")
        .otherwise(F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("slide_file")))
        .alias("image_path"),
        (missing & F.lit(require)).alias("unmapped"),
    )


def prefix_join(dirs: DataFrame, questions: DataFrame, marker: str = "DX1", width: int = 12) -> DataFrame:
    """One row per (slide folder, question of its case); the case is the name's prefix."""
    named = dirs.filter(F.contains(F.col("long_id"), F.lit(marker))).withColumn(
        "short_id", F.substring("long_id", 1, width)
    )
    return named.join(questions, "short_id")


def keep_present(questions: DataFrame, names: DataFrame, slide: str = "slide", marker: str | None = "DX1") -> DataFrame:
    """Questions whose slide is among the file names (cut at their first dot)."""
    if marker is not None:
        names = names.filter(F.contains(F.col("name"), F.lit(marker)))
    return questions.join(
        names.select(slide_of(F.col("name")).alias(slide)), slide, "left_semi"
    )


def join_results(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Every manifest row with its prediction: missing and invalid flags, answer if valid."""
    found = results.select("sample_id", "status", "pred_answer", F.lit(True).alias("_found"))
    missing = F.col("_found").isNull()
    valid = F.coalesce(F.col("status") == "ok", F.lit(False)) & ~missing
    return manifest.join(found, "sample_id", "left").select(
        *manifest.columns,
        missing.alias("missing"),
        (~missing & ~valid).alias("invalid"),
        F.when(valid, F.coalesce("pred_answer", F.lit(""))).otherwise("").alias("pred_answer"),
        valid.alias("valid"),
    )


def outside_manifest(manifest: DataFrame, results: DataFrame) -> DataFrame:
    return results.join(manifest, "sample_id", "left_anti")


def key_mismatches(sides: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys that are not in every side, with one flag per side.

    One union and one aggregation instead of a chain of full joins; repeated keys meet on
    the map side already.
    """
    names = list(sides)
    tagged = None
    for name in names:
        flags = [F.lit(name == other).alias(f"in_{other}") for other in names]
        one = sides[name].select(*keys, *flags)
        tagged = one if tagged is None else tagged.unionByName(one)
    merged = tagged.groupBy(*keys).agg(
        *[F.bool_or(f"in_{name}").alias(f"in_{name}") for name in names]
    )
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(f"in_{name}")
    return merged.filter(~complete)


def scales_per_image(regions: DataFrame) -> DataFrame:
    """Images whose starting regions use more than one scale or kind of scale."""
    kinds = regions.groupBy("image_id").agg(
        F.min("scale_kind").alias("_k0"),
        F.max("scale_kind").alias("_k1"),
        F.min("scale").alias("_s0"),
        F.max("scale").alias("_s1"),
    )
    return kinds.filter((F.col("_k0") != F.col("_k1")) | (F.col("_s0") != F.col("_s1"))).select(
        "image_id"
    )


def _path_ends(path: Column) -> Column:
    """The path and everything after each of its slashes."""
    steps = F.split(path, "/")
    count = F.size(steps)
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda start: F.array_join(F.slice(steps, start, count - start + 1), "/"),
    )


def _wanted_tail() -> Column:
    """The original name without its first folder.

    A member that equals or ends with the whole original name also ends with this tail, so
    the tail alone decides.
    """
    return F.expr("substring(original, instr(original, '/') + 1)")


def _member_tails(members: DataFrame) -> DataFrame:
    return members.select("member", F.explode(_path_ends(F.col("member"))).alias("tail"))


def match_members(mapping: DataFrame, members: DataFrame) -> DataFrame:
    """Archive members for every wanted image, with the number of candidates.

    A member fits when it equals the original name or the name without its first folder,
    or ends with a slash and either. Members are exploded into their path ends and counted
    per end before the equality join, so that a common end never multiplies rows.
    ``mapping`` has (name, original), ``members`` (member). One row per image; ``member``
    is set when there is exactly one candidate.
    """
    counted = (
        _member_tails(members)
        .groupBy("tail")
        .agg(F.count("*").alias("candidates"), F.min("member").alias("_member"))
    )
    n = F.coalesce(F.col("candidates"), F.lit(0)).cast("bigint")
    return (
        mapping.withColumn("tail", _wanted_tail())
        .join(counted, "tail", "left")
        .select(
            "name",
            "original",
            "tail",
            n.alias("candidates"),
            F.when(n == 1, F.col("_member")).alias("member"),
            F.when(n == 1, "matched")
            .when(n == 0, "missing")
            .otherwise("ambiguous")
            .alias("status"),
        )
    )


def ambiguous_members(matched: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate lists of the ambiguous images as (tail, member), each tail once."""
    tails = matched.filter("status = 'ambiguous'").select("tail").distinct()
    return _member_tails(members).join(tails, "tail", "left_semi").select("tail", "member")


def inventory_slides(inventory: DataFrame) -> DataFrame:
    """Slide files of a remote listing: links and files that end in ``.svs``."""
    name = F.btrim("basename")
    usable = F.btrim("type").isin("file", "symbolic_link") & F.lower(name).endswith(".svs")
    return inventory.filter(usable).withColumn("slide_id", F.expr("left(trim(basename), length(trim(basename)) - 4)"))


def match_inventory(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Wanted (cohort, slide_id) rows with match count and, if single, path and size."""
    matches = inventory_slides(inventory).groupBy("cohort", "slide_id").agg(
        F.count("*").alias("matches"),
        F.min("path").alias("_path"),
        F.min(F.col("size").try_cast("bigint")).alias("_size"),
    )
    n = F.coalesce(F.col("matches"), F.lit(0)).cast("bigint")
    return wanted.join(matches, ["cohort", "slide_id"], "left").select(
        "cohort",
        "slide_id",
        n.alias("matches"),
        F.when(n == 1, F.col("_path")).alias("remote_path"),
        F.when(n == 1, F.col("_size")).alias("size_bytes"),
    )


def match_failures(matched: DataFrame) -> DataFrame:
    """Histogram of the match counts that are not one."""
    return matched.filter("matches <> 1").groupBy("matches").agg(F.count("*").alias("slides"))


def choose_package(wanted: DataFrame, packages: DataFrame) -> DataFrame:
    """The first package (by ``rank``) per cohort that has every wanted slide exactly once.

    ``packages`` is an inventory with (cohort, package_id, rank).
    """
    per_slide = (
        inventory_slides(packages)
        .groupBy("cohort", "package_id", "rank", "slide_id")
        .agg(F.count("*").alias("_n"))
        .join(wanted.select("cohort", "slide_id"), ["cohort", "slide_id"])
    )
    covered = per_slide.groupBy("cohort", "package_id", "rank").agg(
        F.count("*").alias("_slides"), F.max("_n").alias("_most")
    )
    sizes = wanted.groupBy("cohort").agg(F.count("*").alias("_wanted"))
    good = covered.join(sizes, "cohort").filter(
        (F.col("_slides") == F.col("_wanted")) & (F.col("_most") == 1)
    )
    best = good.groupBy("cohort").agg(F.min_by("package_id", "rank").alias("package_id"))
    return sizes.select("cohort").join(best, "cohort", "left")


def verify_files(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected files with the number of local ones, of right-sized ones and a verdict."""
    by_size = listing.groupBy("file_id", "size").agg(
        F.count("*").alias("_n"), F.min("path").alias("_path")
    )
    found = expected.select("file_id", "expected_size").join(by_size, "file_id", "left")
    right = F.coalesce(F.col("size") == F.col("expected_size"), F.lit(False))
    grouped = found.groupBy("file_id", "expected_size").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_files"),
        F.coalesce(F.sum(F.when(right, F.col("_n"))), F.lit(0)).alias("n_exact"),
        F.min(F.when(right, F.col("_path"))).alias("_path"),
    )
    ok = F.col("n_exact") == 1
    return grouped.select(
        "file_id",
        "expected_size",
        "n_files",
        "n_exact",
        F.when(ok, F.col("_path")).alias("path"),
        ok.alias("complete"),
    )


def verify_totals(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count("*").alias("expected"),
        F.count_if("complete").alias("complete"),
        F.count_if(~F.col("complete")).alias("problems"),
        F.coalesce(
            F.sum(F.when(F.col("complete"), F.col("expected_size"))), F.lit(0)
        ).alias("bytes_complete"),
    )


TEST_SPLITS = ("test", "test_tiny")


def image_presence(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (source, img) with presence, test membership and the last row's origin.

    ``annotations`` has (source, split, img, source_img, position); ``position`` orders
    the rows of a source, and of repeated images the last row counts.
    """
    images = annotations.groupBy("source", "img").agg(
        F.max_by("source_img", "position").alias("source_img"),
        F.bool_or(F.col("split").isin(*TEST_SPLITS)).alias("in_test"),
    )
    here = files.filter("size > 0").select("img").distinct().withColumn("_here", F.lit(True))
    return images.join(here, "img", "left").select(
        "source", "img", "source_img", "in_test", F.col("_here").isNotNull().alias("present")
    )


def split_counts(annotations: DataFrame) -> DataFrame:
    """Questions per (source, split), per source (null split) and overall (both null).

    The fine counts are made first; the others are sums of them. A row whose own source or split
    is null is counted under the empty name.
    """
    named = [F.coalesce(name, F.lit("")).alias(name) for name in ("source", "split")]
    fine = annotations.groupBy(*named).agg(F.count("*").alias("_n"))
    return fine.rollup("source", "split").agg(F.sum("_n").alias("questions"))


def audit_totals(coverage: DataFrame) -> DataFrame:
    """One row of the sums over all sources; an image of two sources counts in both."""
    names = [name for name in coverage.columns if name != "source"]
    sums = coverage.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    return sums.withColumn("complete", F.col("all_images") == F.col("all_images_present"))


def audit_coverage(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """Per source: images, present ones, the test subset and questions by split."""
    images = image_presence(annotations, files).groupBy("source").agg(
        F.count("*").alias("all_images"),
        F.count_if("present").alias("all_images_present"),
        F.count_if("in_test").alias("test_images"),
        F.count_if(F.col("in_test") & F.col("present")).alias("test_images_present"),
    )
    questions = annotations.groupBy("source").agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("split").isin(*TEST_SPLITS)).alias("test_questions"),
    )
    return questions.join(images, "source")


def pending(work: DataFrame, results: DataFrame, protocol: str) -> DataFrame:
    """Work without a final result under the protocol's rule."""
    final = results.filter(is_terminal(protocol, F.col("status")))
    return work.join(final, "sample_id", "left_anti")


def pending_groups(
    total: DataFrame, done: DataFrame, group: str, exact: bool = False
) -> DataFrame:
    """Groups that still need work, with their counts.

    A group is finished when at least as many items are done as there are, or with
    ``exact`` when the two numbers agree.
    """
    wanted = total.groupBy(group).agg(F.count("*").alias("total"))
    have = done.groupBy(group).agg(F.count("*").alias("_done"))
    counted = wanted.join(have, group, "left").withColumn(
        "done", F.coalesce(F.col("_done"), F.lit(0)).cast("bigint")
    )
    finished = (F.col("done") == F.col("total")) if exact else (F.col("done") >= F.col("total"))
    return counted.filter(~finished).select(group, "total", "done")


def check_identity(results: DataFrame, locks: DataFrame) -> DataFrame:
    """Per run: results, results with another or no run hash, and whether all runs agree.

    Runs with results but without a lock are included; all their results mismatch.

    ``results`` has (run, sample_id, run_hash); ``locks`` (run, lock_hash, config_hash,
    code_hash).
    """
    per_hash = results.groupBy("run", "run_hash").agg(F.count("*").alias("_n"))
    agree = locks.agg(
        (F.count_distinct("config_hash") <= 1).alias("one_config"),
        (F.count_distinct("code_hash") <= 1).alias("one_code"),
    )
    wrong = ~F.col("run_hash").eqNullSafe(F.col("lock_hash")) | F.col("lock_hash").isNull()
    return (
        locks.join(per_hash, "run", "full")
        .groupBy("run")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("results"),
            F.coalesce(F.sum(F.when(wrong, F.col("_n"))), F.lit(0)).alias("mismatched"),
        )
        .crossJoin(F.broadcast(agree))
    )


def attest(profile: DataFrame, required: dict[str, Column]) -> DataFrame:
    """Fields of a run profile that differ from their required value."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.col(name).cast("string").alias("found"),
                value.cast("string").alias("required"),
            )
            for name, value in required.items()
        ]
    )
    return (
        profile.select("run", F.explode(pairs).alias("_p"))
        .select("run", "_p.field", "_p.found", "_p.required")
        .filter(~F.col("found").eqNullSafe(F.col("required")))
    )
