"""Answer options and the mapping of answers to option labels.

Options are ``array<struct<label,text>>`` so that their order is kept; an open question
has an empty array and an unreadable value is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import SPACE, let, normalize_text, strip

OPTIONS_TYPE = "array<struct<label:string,text:string>>"

# The accepted spellings of option labels.
LABEL_PREFIX = rf"(?s)\A\(?([A-Z])\)?[.)]{SPACE}*(.+)\z"
LABEL_IN_STRING = rf"(?:\A|{SPACE})([A-Z])[.)]{SPACE}*"
BARE_LABEL = r"\A\(?([A-Z])\)?[.)]?\z"

_START, _MID = "\ue000", "\ue001"


def option(label: Column, text: Column) -> Column:
    return F.struct(label.alias("label"), text.alias("text"))


def no_options() -> Column:
    return F.array().cast(OPTIONS_TYPE)


def _keep_last(entries: Column) -> Column:
    """One entry per label: position of the first, text of the last."""
    def same_label(entry: Column) -> Column:
        return F.filter(entries, lambda other: other.label == entry.label)

    firsts = F.filter(
        entries,
        lambda entry, i: ~F.exists(F.slice(entries, 1, i), lambda other: other.label == entry.label),
    )
    return F.transform(
        firsts, lambda entry: option(entry.label, F.element_at(same_label(entry), -1).text)
    )


def _from_list(items: Column) -> Column:
    def labelled(item: Column, i: Column) -> Column:
        def read(text: Column) -> Column:
            label = F.regexp_extract(text, LABEL_PREFIX, 1)
            body = strip(F.regexp_extract(text, LABEL_PREFIX, 2))
            return F.when(label != "", option(label, body)).otherwise(
                option(F.char(F.lit(65) + i), text)
            )

        return let(strip(F.coalesce(item, F.lit(""))), read)

    # Blanks go after labelling: they use up their positional letter.
    return F.filter(F.transform(items, labelled), lambda entry: entry.text != "")


def _from_map(items: Column) -> Column:
    entries = F.transform(
        F.map_entries(items),
        lambda entry: option(
            F.upper(F.btrim(entry.key, F.lit("(). "))), strip(F.coalesce(entry.value, F.lit("")))
        ),
    )
    return F.filter(entries, lambda entry: entry.text != "")


def _from_labelled(text: Column) -> Column:
    marked = F.regexp_replace(text, LABEL_IN_STRING, f"{_START}$1{_MID}")
    found = F.split(marked, _START)
    parts = F.slice(found, F.lit(2), F.size(found))
    entries = F.transform(
        parts,
        lambda part: option(
            F.substring_index(part, _MID, 1), strip(F.substring_index(part, _MID, -1))
        ),
    )
    return F.filter(entries, lambda entry: entry.text != "")


def checked(entries: Column) -> Column:
    """Null unless there are two or more options, all with one capital letter."""
    def good(unique: Column) -> Column:
        letters = F.forall(unique, lambda entry: entry.label.rlike(r"\A[A-Z]\z"))
        return F.when((F.size(unique) >= 2) & letters, unique)

    return let(entries, lambda found: let(_keep_last(found), good))


def normalize_choices(raw: Column) -> Column:
    """Options from a JSON list, a JSON object or a labelled ``A. … B. …`` string."""
    def read(parsed: Column) -> Column:
        return (
            F.when(parsed.as_list.isNotNull(), _from_list(parsed.as_list))
            .when(parsed.as_map.isNotNull(), _from_map(parsed.as_map))
            .otherwise(_from_labelled(raw))
        )

    # The parser stops behind the first value; what does not end with its bracket has more.
    whole = strip(raw)
    parsed = F.struct(
        F.when(F.endswith(whole, F.lit("]")), F.from_json(raw, "array<string>")).alias("as_list"),
        F.when(F.endswith(whole, F.lit("}")), F.from_json(raw, "map<string,string>")).alias("as_map"),
    )
    return F.when(F.coalesce(raw, F.lit("")) == "", no_options()).otherwise(
        checked(let(parsed, read))
    )


def choices_from_columns(*texts: tuple[str, Column]) -> Column:
    """Options from one column per label; blank cells are left out, none at all means open."""
    entries = F.array(
        *[option(F.lit(label), strip(F.coalesce(text, F.lit("")))) for label, text in texts]
    )
    present = F.filter(entries, lambda entry: entry.text != "")
    return let(
        present, lambda found: F.when(F.size(found) == 0, no_options()).otherwise(checked(found))
    )


def text_of(choices: Column, label: Column) -> Column:
    return F.get(F.filter(choices, lambda entry: entry.label == label), F.lit(0)).text


def answer_label(answer: Column, choices: Column) -> Column:
    """Label meant by ``answer``, or null when that is not certain."""
    nothing = F.lit(None).cast("string")

    def by_text(key: Column) -> Column:
        hits = F.filter(choices, lambda entry: normalize_text(entry.text) == key)
        return let(hits, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)).label))

    def by_label(text: Column) -> Column:
        label = F.regexp_extract(text, LABEL_PREFIX, 1)
        body = F.regexp_extract(text, LABEL_PREFIX, 2)
        agrees = normalize_text(body) == normalize_text(text_of(choices, label))
        return F.when(label == "", let(normalize_text(text), by_text)).when(agrees, label)

    def read(text: Column) -> Column:
        bare = F.regexp_extract(F.upper(text), BARE_LABEL, 1)
        known = (bare != "") & text_of(choices, bare).isNotNull()
        return F.when(text == "", nothing).when(known, bare).otherwise(by_label(text))

    closed = F.coalesce(F.size(choices), F.lit(0)) > 0
    return F.when(closed, let(strip(F.coalesce(answer, F.lit(""))), read))


def choices_key(choices: Column) -> Column:
    """Options as one comparable string, ``A=…|B=…``."""
    return F.array_join(
        F.transform(choices, lambda entry: F.concat(entry.label, F.lit("="), entry.text)), "|"
    )


def same_answer(choices: Column, gold: Column, answer: Column) -> Column:
    """Do two answers name the same option? False when either is unclear."""
    return F.coalesce(answer_label(gold, choices) == answer_label(answer, choices), F.lit(False))


__all__ = [
    "answer_label",
    "choices_from_columns",
    "choices_key",
    "normalize_choices",
    "option",
    "same_answer",
    "text_of",
]
