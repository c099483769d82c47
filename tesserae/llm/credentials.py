r"""Secrets in texts, with linking of credentials that come in several parts.

Strong findings are reported wherever they stand: assignments of long values to secret names,
access identifiers, and long hexadecimal runs. Weak candidates are parts of a credential that would
mostly be noise alone: assignments of short values, names of accounts, short identifiers and
hexadecimal runs, and endpoints (URLs and addresses). A weak candidate is reported only if a part that
complements it lies in its scope: a secret for an account or an endpoint, an account or an
endpoint for a secret. Parts are in one scope if they don't overlap, at most ``scope`` code points
lie between them, and no blank line does.

All of it is SQL functions. Patterns give matches and the gaps between them, whose running lengths
are positions in code points. The interval join of candidates with scopes is a sweep: ends of parts
and starts of candidates are dealt into bins of ``scope`` code points, ends into the next bin too,
and a window over each bin in order carries the last end of each role; a mirrored sweep looks the
other way. No pairs are made, and a bin holds no more than its stretch of one text.

Results per row: null and empty texts have no spans. Repeated rows and repeated or null ids are read
row by row, under a row number that is written with the matches. An empty table gives no rows.
Columns other than id and text are not read. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import small, written

SCOPE = 200
LONG_VALUE = 8
SHORT_VALUE = 4
LONG_ACCESS = 16
SHORT_ACCESS = 8
LONG_HEX = 32
SHORT_HEX = 16


def either_case(*names: str) -> str:
    """A pattern of names in small letters and capitals, of ASCII only in every engine."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in names)


ASSIGNS = r"""["']?\x20*[:=]\x20*["']?"""
SECRET_NAMES = either_case("password", "passwd", "secret", "token", "api_?key")
ACCOUNT_NAMES = either_case("access_?key_?id", "client_?id", "account", "user_?name", "user", "login")
HOST_NAMES = either_case("endpoint", "hostname", "host", "server")
SCHEMES = "https?|ftps?|sftp|ssh|s3|postgres(?:ql)?|mysql|mongodb(?:[+]srv)?|rediss?|amqps?|ldaps?|wss?"

#: The scans, by name. Group 1 of the first is the value.
PATTERNS = {
    "assign": f"(?:{SECRET_NAMES}){ASSIGNS}([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    # Shorter runs are no part of any finding.
    "hex": f"[0-9a-f]{{{SHORT_HEX},}}",
    "account": f"(?:{ACCOUNT_NAMES}){ASSIGNS}[A-Za-z0-9._@-]{{3,}}",
    "endpoint": (
        f"(?:{SCHEMES})://[^\\x00-\\x20\"'<>\\x7F]+"
        r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?"
        f"|(?:{HOST_NAMES}){ASSIGNS}[A-Za-z0-9.-]{{4,}}"
    ),
}
BLANK_LINE = r"\n[\x20\t\r]*\n"

#: Kinds of spans in the order of reports, and the role of each. The first three are strong.
KINDS = ["assign", "access", "hex", "short_assign", "account", "short_access", "short_hex", "endpoint"]
STRONG = 3
ROLES = ["secret", "access", "secret", "secret", "access", "access", "secret", "endpoint"]


def _lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda piece: F.length(piece))


def matches(docs: DataFrame) -> DataFrame:
    """A written table (row, doc_id, and for each pattern the lengths of gaps and the matches)."""
    scanned = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in PATTERNS.items():
        scanned = scanned.withColumn(name, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    gaps = [
        F.when(F.size(name) > 0, _lengths(F.split("text", pattern, -1))).alias(f"{name}_gaps")
        for name, pattern in PATTERNS.items()
    ]
    some = sum((F.size(name) for name in PATTERNS), F.lit(0)) > 1
    breaks = F.when(some, F.regexp_extract_all("text", F.lit(BLANK_LINE), F.lit(0)))
    break_gaps = F.when(some, _lengths(F.split("text", BLANK_LINE, -1)))
    row = F.monotonically_increasing_id().alias("row")
    columns = [breaks.alias("break"), break_gaps.alias("break_gaps")]
    return written(scanned.select(row, "doc_id", *PATTERNS, *gaps, *columns), "matches")


def positions(found: DataFrame, name: str) -> DataFrame:
    """(row, text, start, end) of the matches of one pattern."""
    pairs = found.filter(F.size(name) > 0).select("row", F.posexplode(F.arrays_zip(F.col(name), F.col(f"{name}_gaps"))))
    pairs = pairs.filter(F.col(f"col.{name}").isNotNull())
    size = F.length(f"col.{name}").cast("bigint")
    order = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(size + F.col(f"col.{name}_gaps")).over(order)
    return pairs.select("row", F.col(f"col.{name}").alias("text"), (end - size).alias("start"), end.alias("end"))


def candidates(found: DataFrame) -> DataFrame:
    """(row, kind, start, end): strong findings and weak candidates; kind is a place in KINDS."""
    size = F.length("text")
    value = F.length(F.regexp_extract("text", PATTERNS["assign"], 1))
    mixed = F.col("text").rlike("[a-f]") & F.col("text").rlike("[0-9]")
    kinds = {
        "assign": F.when(value >= LONG_VALUE, 0).when(value >= SHORT_VALUE, 3),
        "access": F.when(size >= LONG_ACCESS, 1).when(size >= SHORT_ACCESS, 5),
        "hex": F.when(size >= LONG_HEX, 2).when(mixed, 6),
        "account": F.lit(4),
        "endpoint": F.lit(7),
    }
    parts = None
    for name, kind in kinds.items():
        part = positions(found, name).select("row", kind.alias("kind"), "start", "end").filter("kind is not null")
        parts = part if parts is None else parts.unionByName(part)
    return written(parts, "candidates")


def linked(parts: DataFrame, breaks: DataFrame, scope: int) -> DataFrame:
    """The weak ones of the parts (row, kind, start, end) that a complement in their scope
    supports; breaks (row, start, end) end scopes."""
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("kind") + 1)
    both = parts.withColumn("role", role).unionByName(
        breaks.select("row", F.lit(-1).alias("kind"), "start", "end", F.lit("break").alias("role"))
    )
    # The second side is the same text read from its end.
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("start").alias("from"), F.col("end").alias("to")),
        F.struct(F.lit(1).alias("side"), (-F.col("end")).alias("from"), (-F.col("start")).alias("to")),
    )
    both = both.select("*", F.explode(sides).alias("s")).select("row", "kind", "start", "end", "role", "s.*")

    def bin_of(place: Column) -> Column:
        return F.floor(place / scope).cast("bigint")

    ends = both.select("*", F.explode(F.array(bin_of(F.col("to")), bin_of(F.col("to")) + 1)).alias("bin"))
    ends = ends.withColumn("at", F.col("to")).withColumn("asks", F.lit(False))
    asking = both.filter(F.col("kind") >= STRONG).withColumn("bin", bin_of(F.col("from")))
    asking = asking.withColumn("at", F.col("from")).withColumn("asks", F.lit(True))
    sweep = Window.partitionBy("row", "side", "bin").orderBy("at", "asks")
    sweep = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.unionByName(asking)
    for name in ("secret", "access", "endpoint", "break"):
        swept = swept.withColumn(f"last_{name}", F.max(F.when(~F.col("asks") & (F.col("role") == name), F.col("at"))).over(sweep))

    def near(name: str) -> Column:
        last = F.col(f"last_{name}")
        whole = F.col("last_break").isNull() | (last >= F.col("last_break"))
        return F.coalesce((last >= F.col("at") - scope) & whole, F.lit(False))

    supported = F.when(F.col("role") == "secret", near("access") | near("endpoint")).otherwise(near("secret"))
    return swept.filter(F.col("asks") & supported).select("row", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans) of documents (doc_id, text): spans are structs (start, kind, end) in code
    points, end exclusive, by start and kind; kind is a place in KINDS."""
    found = matches(docs)
    parts = candidates(found)
    weak = parts.filter(F.col("kind") >= STRONG).select("row").distinct()
    breaks = positions(found, "break").join(weak, "row", "left_semi").select("row", "start", "end")
    reported = parts.filter(F.col("kind") < STRONG).unionByName(linked(parts, breaks, scope))
    by_row = reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    by_row = small(written(by_row, "spans"))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    rows = found.select("row", "doc_id").join(by_row, "row", "left")
    return rows.select("doc_id", F.coalesce("spans", empty).alias("spans"))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(texts, ",")
