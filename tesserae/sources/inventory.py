"""Ragged remote listings without or with a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.runtime import require_empty

# Leading columns of a listing, and its two kinds of usable entries.
COLUMNS = ("path", "basename", "type", "size")
FILE, LINK = "file", "symbolic_link"
# One cell: quoted, with doubled quotes inside, or plain. A cell is found at a time, so the
# length of a line does not matter.
_CELL = r'(?:\A|,)("[^"]*+(?:""[^"]*+)*+"(?=,|\z)|[^,]*+)'


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line of any length; quotes protect commas and double themselves."""
    cells = F.regexp_extract_all(line, F.lit(_CELL), F.lit(1))
    return F.transform(
        cells,
        lambda cell: F.when(
            cell.rlike(r'(?s)\A".*"\z'),
            F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )


def _cell(cells: Column, at: int) -> Column:
    return F.coalesce(F.get(cells, F.lit(at)), F.lit(""))


def _split(lines: DataFrame, line: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.col(line), "\\A\ufeff", ""), r"\r\z", "")
    split = lines.filter(F.col(line) != "").withColumn("_cells", csv_cells(bare))
    header = F.lit(True)
    for at, name in enumerate(COLUMNS):
        header = header & (_cell(F.col("_cells"), at) == name)
    return split.withColumn("_header", header)


def malformed_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines with fewer than three cells, or with a quote that is not closed (a cell with a
    line break inside is cut there)."""
    quotes = F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))
    short = F.size("_cells") < 3
    return _split(lines, line).filter(short | (quotes % 2 == 1)).drop("_cells", "_header")


def parse_inventory(lines: DataFrame, line: str = "value", listing: str | None = None) -> DataFrame:
    """(path, basename, type, size) per line; size stays text and may be blank.

    ``listing`` names the column that tells listings apart (default: all lines are one). In
    a listing with a header line the cells are taken as they are named. Without one, type
    and size are trimmed, and a link carries the size of its target, which follows the first
    ``file`` cell after the third that has digits behind it.
    """
    split = _split(lines, line)
    if listing is None:
        listing = "_listing"
        split = split.withColumn(listing, F.lit(""))
    named = split.filter("_header").select(listing).distinct().withColumn("_named", F.lit(True))
    rows = split.filter(~F.col("_header")).join(named, listing, "left")
    cells = F.col("_cells")
    trimmed = F.transform(cells, lambda cell: F.btrim(cell))
    kind = _cell(trimmed, 2)
    digits = r"\A\d+\z"
    own = _cell(trimmed, 3)
    places = F.filter(
        F.sequence(F.lit(3), F.greatest(F.size(cells) - 2, F.lit(3))),
        lambda at: (F.coalesce(F.get(trimmed, at), F.lit("")) == FILE)
        & F.coalesce(F.get(trimmed, at + 1), F.lit("")).rlike(digits),
    )
    target = F.get(trimmed, F.get(places, F.lit(0)) + 1)
    size = (
        F.when((kind == FILE) & own.rlike(digits), own)
        .when(kind == LINK, F.coalesce(target, F.lit("")))
        .otherwise("")
    )
    headed = F.col("_named").isNotNull()
    extra = [column for column in lines.columns if column != line]
    return rows.select(
        *extra,
        _cell(cells, 0).alias("path"),
        _cell(cells, 1).alias("basename"),
        F.when(headed, _cell(cells, 2)).otherwise(kind).alias("type"),
        F.when(headed, _cell(cells, 3)).otherwise(size).alias("size"),
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The listings of all files at ``path``; a malformed line is an error."""
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    require_empty(malformed_lines(lines), "malformed inventory line")
    return parse_inventory(lines, listing="_file").drop("_file")
