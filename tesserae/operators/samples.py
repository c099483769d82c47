"""Building, validating and summarising question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.choices import answer_label
from tesserae.functions.geometry import is_valid_mpp
from tesserae.functions.text import is_blank

# Columns that tell or explain the right answer.
GOLD_COLUMNS = ("ground_truth", "ground_truth_label", "answer", "explanation")

SAMPLE_COLUMNS = (
    "dataset",
    "split",
    "sample_id",
    "image_id",
    "image_path",
    "question",
    "choices",
    "ground_truth",
    "ground_truth_label",
    "task",
    "source",
    "input_kind",
    "assumed_mpp",
)


def _text_or(df: DataFrame, column: str, default: str) -> Column:
    given = F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
    return F.coalesce(given, F.lit(default))


def make_samples(
    df: DataFrame,
    dataset: str,
    split: str | None = None,
    input_kind: str = "wsi",
    assumed_mpp: float | None = None,
) -> DataFrame:
    """Question rows in one schema, with the label of the right answer.

    ``df`` has (sid, image_id, question, choices, answer) and optionally image_path, split,
    task, source. A right answer that maps to no option gives a null label, which
    :func:`validate` reports.
    """
    choices = F.col("choices")
    return df.select(
        F.lit(dataset).alias("dataset"),
        (F.lit(split) if split is not None else F.col("split")).alias("split"),
        F.concat(F.lit(f"{dataset}:"), F.col("sid").cast("string")).alias("sample_id"),
        F.col("image_id").cast("string").alias("image_id"),
        _text_or(df, "image_path", "").alias("image_path"),
        F.col("question").cast("string").alias("question"),
        choices.alias("choices"),
        F.col("answer").cast("string").alias("ground_truth"),
        answer_label(F.col("answer"), choices).alias("ground_truth_label"),
        _text_or(df, "task", "").alias("task"),
        _text_or(df, "source", "").alias("source"),
        F.lit(input_kind).alias("input_kind"),
        F.lit(assumed_mpp).cast("double").alias("assumed_mpp"),
    )


def public_input(df: DataFrame) -> DataFrame:
    """What a model may see: the row without its gold columns."""
    return df.drop(*GOLD_COLUMNS)


def require_public(df: DataFrame) -> DataFrame:
    leaked = sorted(set(df.columns) & set(GOLD_COLUMNS))
    if leaked:
        raise ValueError(f"gold columns in model input: {leaked}")
    return df


def is_safe_name(name: Column) -> Column:
    """A plain file name: no folder part and not a dot entry."""
    return ~F.contains(name, F.lit("/")) & ~name.isin("", ".", "..")


def is_inside(path: Column) -> Column:
    """A relative path that never climbs above its start."""
    steps = F.filter(F.split(path, "/"), lambda step: ~step.isin("", "."))
    depth = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda acc, step: F.struct(
            (acc.now + F.when(step == "..", -1).otherwise(1)).alias("now"),
            F.least(acc.low, acc.now + F.when(step == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    return ~F.startswith(path, F.lit("/")) & (depth.low >= 0)


def reject_reason(df: DataFrame) -> Column:
    """The first broken rule of a sample row, or null."""
    rules = [
        ("bad_choices", F.col("choices").isNull()),
        (
            "unmappable_truth",
            (F.size("choices") > 0) & F.col("ground_truth_label").isNull(),
        ),
        ("empty_question", is_blank(F.col("question"))),
    ]
    if "image_path" in df.columns:
        rules.append(
            ("unsafe_path", (F.col("image_path") != "") & ~is_inside(F.col("image_path")))
        )
    if "position" in df.columns:
        position = F.col("position").cast("string")
        number = position.try_cast("int")
        rules.append(
            ("bad_position", position.isNotNull() & ~F.coalesce(number.between(1, 4), F.lit(False)))
        )
    if "mpp" in df.columns:
        rules.append(("bad_mpp", ~is_valid_mpp(F.col("mpp"))))
        rules.append(
            ("missing_scale", (F.col("input_kind") == "wsi") & F.col("mpp").isNull())
        )
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return reason


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", reject_reason(df))
    return (
        marked.filter("reject_reason IS NULL").drop("reject_reason"),
        marked.filter("reject_reason IS NOT NULL"),
    )


def letter_to_text(df: DataFrame, options: list[str], answer: str) -> DataFrame:
    """Replace a right answer A-D by its option text; leave anything else."""
    letter = F.upper(F.btrim(F.col(answer)))
    texts = F.array(*[F.col(option) for option in options])
    place = F.ascii(letter) - F.ascii(F.lit("A"))
    known = (F.length(letter) == 1) & place.between(0, len(options) - 1)
    return df.withColumn(answer, F.when(known, F.get(texts, place)).otherwise(F.col(answer)))


def check_expected(
    df: DataFrame, questions: int | Column | None, images: int | Column | None
) -> DataFrame:
    """One row: expected and found question and image counts and whether they agree."""
    found = df.agg(
        F.count("*").alias("questions"), F.count_distinct("image_id").alias("images")
    )
    want_questions = F.lit(questions).cast("bigint")
    want_images = F.lit(images).cast("bigint")
    agree = (want_questions.isNull() | (want_questions == F.col("questions"))) & (
        want_images.isNull() | (want_images == F.col("images"))
    )
    return found.select(
        want_questions.alias("expected_questions"),
        "questions",
        want_images.alias("expected_images"),
        "images",
        F.coalesce(agree, F.lit(False)).alias("ok"),
    )


def summarize(df: DataFrame) -> DataFrame:
    """Question and image counts overall, by task and by source: (kind, name, …).

    Questions are first counted per (image, task, source), so that the distinct image
    count works on far fewer rows.
    """
    cells = df.groupBy("image_id", "task", "source").agg(F.count("*").alias("_n"))
    labelled = cells.select(
        "image_id",
        "_n",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")),
                F.struct(F.lit("task").alias("kind"), F.col("task").alias("name")),
                F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")),
            )
        ).alias("_group"),
    ).select("image_id", "_n", "_group.kind", "_group.name")
    per_image = labelled.groupBy("kind", "name", "image_id").agg(F.sum("_n").alias("_n"))
    return per_image.groupBy("kind", "name").agg(
        F.sum("_n").alias("questions"), F.count("*").alias("images")
    )


def availability(samples: DataFrame, present: DataFrame, key: str = "img") -> DataFrame:
    """Summaries of the release and of its available part, with the missing questions."""
    here = samples.join(present.select(key), key, "left_semi")
    release, available = [
        summarize(side).withColumnsRenamed(
            {"questions": f"{name}_questions", "images": f"{name}_images"}
        )
        for name, side in (("release", samples), ("available", here))
    ]
    found = [F.coalesce(f"available_{c}", F.lit(0)).cast("bigint") for c in ("questions", "images")]
    return release.join(available, ["kind", "name"], "left").select(
        "kind",
        "name",
        "release_questions",
        "release_images",
        found[0].alias("available_questions"),
        found[1].alias("available_images"),
        (F.col("release_questions") - found[0]).alias("missing_questions"),
    )
