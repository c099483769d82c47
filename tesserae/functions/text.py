"""Text keys and JSON-encoded strings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space in text keys. The engines'
# own ``\s`` covers only ASCII, so the Unicode members are listed.
SPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters through Java's Unicode flag, which is twice as fast on long texts.
UNICODE_SPACES = r"(?U)[\s\x1C-\x1F]+"
SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
SPACE_CHARS = "".join(chr(c) for low, high in SPACE_RANGES for c in range(low, high + 1))


def _folds() -> dict[str, str]:
    """Full case folding of every letter for which lower-casing gives something else."""
    letters = map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)])
    return {c: c.casefold() for c in letters if c.casefold() != c.lower()}


FOLDS = _folds()
# The most frequent of them in running text have a replacement of their own.
FREQUENT = ("ß", "µ")
_SINGLE = {c: fold for c, fold in FOLDS.items() if len(fold) == 1 and c not in FREQUENT}
_LONGER = {c: fold for c, fold in FOLDS.items() if len(fold) > 1 and c not in FREQUENT}


def _letter_class(letters: Iterable[str]) -> str:
    """A character class of letters, neighbours as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


# A quick test first: few texts have letters from there on, apart from signs.
_BEYOND_LATIN = "[\\x{149}-\\x{1FFF}\\x{A000}-\\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row.

    A value used inside a lambda is computed again for every element unless it is a
    lambda variable itself.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def normalize_text(text: Column) -> Column:
    """Collapse white space, trim, fold case; null becomes the empty string."""
    key = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNICODE_SPACES, " "))
    # The small form of the capital sigma would depend on the letters around it.
    low = F.lower(F.replace(key, F.lit("Σ"), F.lit("σ")))
    for letter in FREQUENT:
        low = F.replace(low, F.lit(letter), F.lit(FOLDS[letter]))
    single = lambda t: F.translate(t, "".join(_SINGLE), "".join(_SINGLE.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(fold).alias("fold")) for c, fold in _LONGER.items()])
    longer = lambda t: F.aggregate(pairs, t, lambda done, pair: F.replace(done, pair["c"], pair["fold"]))

    def folded(t: Column) -> Column:
        once = F.when(t.rlike(_letter_class(_SINGLE)), single(t)).otherwise(t)
        return F.when(t.rlike(_letter_class(_LONGER)), longer(once)).otherwise(once)

    # Once per row: the long expression stands in the condition and in both results.
    return let(low, lambda t: F.when(t.rlike(_BEYOND_LATIN), folded(t)).otherwise(t))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


# JSON short escapes; other control characters use \\u00xx (lower case).
SHORT_ESCAPES = (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r"))


def control_escapes() -> list[tuple[str, str]]:
    short = {char for char, _ in SHORT_ESCAPES}
    return [(chr(code), f"\\u{code:04x}") for code in range(32) if chr(code) not in short]


def json_string(text: Column) -> Column:
    """``text`` as a canonical JSON string literal (non-ASCII left as it is).

    Spark's own encoder differs only in writing rare control characters with capital
    digits, so texts with such an escape take the slower, explicit way.
    """
    encoded = F.to_json(F.array(text))
    quick = F.substring(encoded, F.lit(2), F.length(encoded) - 2)
    slow = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escape in (*SHORT_ESCAPES, *control_escapes()):
        slow = F.replace(slow, F.lit(char), F.lit(escape))
    slow = F.concat(F.lit('"'), slow, F.lit('"'))
    return F.when(
        text.isNotNull(), F.when(F.contains(encoded, F.lit("\\u00")), slow).otherwise(quick)
    )


def json_or_null(text: Column) -> Column:
    return F.coalesce(json_string(text), F.lit("null"))


def json_value(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a value of any type: strings are quoted, containers keep their form,
    map entries are sorted by key. A number that JSON has no form for is an error."""
    if isinstance(kind, T.StringType):
        return json_or_null(value)
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda item: json_value(item, kind.elementType))
        found = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda entry: F.concat(
                json_string(entry.key.cast("string")), F.lit(": "), json_value(entry.value, kind.valueType)
            ),
        )
        found = F.concat(F.lit("{"), F.array_join(F.array_sort(entries), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = {f.name: json_value(value.getField(f.name), f.dataType) for f in kind.fields}
        found = F.when(value.isNotNull(), json_object(**fields))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        found = F.when(odd, F.raise_error(F.lit("a number without a form in JSON"))).otherwise(value.cast("string"))
    elif isinstance(kind, (T.NumericType, T.BooleanType, T.NullType)):
        found = value.cast("string")
    else:
        found = json_string(value.cast("string"))
    return F.coalesce(found, F.lit("null"))


def json_list(*items: Column) -> Column:
    """Items already encoded as JSON, joined with the canonical ``", "``."""
    return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))


def json_object(**items: Column) -> Column:
    """Keys in sorted order with canonical separators; values already encoded as JSON."""
    parts = [F.concat(F.lit(f'"{key}": '), items[key]) for key in sorted(items)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
