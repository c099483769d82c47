import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserae.functions import prompts
from tesserae.functions.choices import (
    answer_label,
    choices_from_columns,
    choices_key,
    normalize_choices,
    same_answer,
)
from tesserae.functions.digest import digest_list, sample_seed, seeded_digest, unique_id
from tesserae.functions.text import json_object, json_string, normalize_text, strip


def values(spark, expression, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    return [row[0] for row in rows.orderBy("i").select(expression(F.col("c"))).collect()]


def test_normalize_text(spark):
    texts = [" A  b\n\tC ", "Straße", "ΣΑΣ", None, "\x1cx 　y", ""]
    wanted = ["a b c", "strasse", "σασ", "", "x y", ""]
    assert values(spark, normalize_text, texts) == wanted
    assert values(spark, strip, ["  a b \x1f", "\n"]) == ["a b", ""]


def test_every_letter_folds_like_its_own(spark):
    """All assigned code points, between letters that could change a fold."""
    codes = [c for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["a" + " ".join(map(chr, codes[i : i + 500])) + "Aς" for i in range(0, len(codes), 500)]
    wanted = [" ".join(t.split()).casefold() for t in texts]
    assert values(spark, normalize_text, texts) == wanted


@pytest.mark.parametrize(
    "raw,key",
    [
        ('["A) yes", "B) no", ""]', "A=yes|B=no"),
        ('["yes", "", "no"]', "A=yes|C=no"),
        ('["yes", null, "(D) no"]', "A=yes|D=no"),
        ('["(B) two", "B. again", "x"]', "B=again|C=x"),
        ('{"a": "one", "(B).": "two", "C": null, "D": " "}', "A=one|B=two"),
        ("A. one B) two words C. three", "A=one|B=two words|C=three"),
        ("A.one\nB.two", "A=one|B=two"),
        ("", ""),
        (None, ""),
        ("no labels here", None),
        ('["only"]', None),
        ('{"A": "one", "BB": "two"}', None),
        ('["A) multi\\nline", "B) x"]', "A=multi\nline|B=x"),
    ],
)
def test_normalize_choices(spark, raw, key):
    assert values(spark, lambda c: choices_key(normalize_choices(c)), [raw]) == [key]


@pytest.mark.parametrize(
    "answer,label",
    [
        ("A) yes", "A"), ("NO", "B"), ("(b)", "B"), ("a.", "A"), (" no\t", "B"), ("B. No", "B"),
        ("", None), ("zzz", None), ("A) no", None), ("Answer: A", None), ("yes maybe", None),
        (None, None), ("C", None), ("C) yes", None),
    ],
)
def test_answer_label(spark, answer, label):
    choices = choices_from_columns(("A", F.lit("yes")), ("B", F.lit("no")), ("C", F.lit(" ")))
    assert values(spark, lambda c: answer_label(c, choices), [answer]) == [label]


def test_answer_label_needs_one_match_and_choices(spark):
    twice = normalize_choices(F.lit('["Same", "same ", "other"]'))
    assert values(spark, lambda c: answer_label(c, twice), ["same"]) == [None]
    empty = normalize_choices(F.lit(""))
    assert values(spark, lambda c: answer_label(c, empty), ["A"]) == [None]
    pair = normalize_choices(F.lit("A. x B. y"))
    assert values(spark, lambda c: same_answer(pair, F.lit("A"), c), ["x", "y", "?"]) == [
        True, False, False,
    ]


TEXTS = ["plain", 'q"uo\\te', "line\nbreak\r\t\b\f", "\x00\x01\x0b\x1a\x1f", "ünï/☃ \x7f", "", "\\u000B"]


def test_json_string_is_canonical(spark):
    wanted = [json.dumps(text, ensure_ascii=False) for text in TEXTS]
    assert values(spark, json_string, TEXTS) == wanted
    assert values(spark, json_string, [None]) == [None]
    made = values(spark, lambda c: json_object(b=json_string(c), a=F.lit("1")), TEXTS)
    assert made == [json.dumps({"a": 1, "b": t}, sort_keys=True, ensure_ascii=False) for t in TEXTS]


def test_digests_and_seeds(spark):
    sha = lambda value: hashlib.sha256(json.dumps(value, ensure_ascii=False).encode()).hexdigest()
    assert values(spark, lambda c: digest_list(c, F.lit("x")), TEXTS) == [sha([t, "x"]) for t in TEXTS]
    assert values(spark, lambda c: seeded_digest(128, c), ["17"]) == [sha([128, "17"])]
    seeds = values(spark, lambda c: sample_seed(7, c, F.lit("agent")), ["s:1", "s:2"])
    assert seeds == [int(sha([7, s, "agent"])[:8], 16) for s in ("s:1", "s:2")]
    ids = values(spark, lambda c: unique_id(F.lit("slide"), c), ["Which?"])
    assert ids == ["slide_" + hashlib.md5(b"Which?").hexdigest()[:8]]


# Published digests of the template texts.
TEMPLATE_SHA256 = {
    "GENERIC": "c34094e26bf52b321e76e386eba6963bd6419f0a1236e12f68889edeb5cdc13b",
    "QUESTION": "d41c78e424aa9d51277855e01697202e3cc66125db1b9936aaf8237f7bb3a07a",
    "PERCEPTOR_SYSTEM": "3026aca60ab30356da35581c82f44b8c5fd8cd7669295956babca4297ff28638",
    "PREDICT_SYSTEM": "bb67e53852c8bd0c66cdba094d5644a32ceeaa5aa31de7e20d22b4e909dd09e5",
    "REFLECT_SYSTEM": "a796ffe8e488b26b748f2eaa4b5bc52acd531bf01df4beb5302ece0112c3df42",
    "MISSING_SYSTEM": "b0b71bf6ed8ebb00387953d527bb504326f2890dcadf9076546f1cecbe196596",
    "FINAL_SYSTEM": "f24dd24d9e1b61560aa597b27a96881769ad3373f839b21cb69aaa4469cb2880",
    "SUMMARY_SYSTEM": "f8349d805ea70de8efbfa3877f123f77181f96f093ceab6d1514cdb594e79296",
    "PREDICT": "784477d9dd16f142b823a153b789fe047fc9803980c2252dce22b9885b0c64de",
    "REFLECT": "41eec4737b5d6aa6aea7656097730f7a55c6cd910432630838c3d5a810aa3d52",
    "MISSING": "49f2f8716b245c4f8d4591e68f68b581e394088914bf84fd30508511ffce5006",
    "FINAL": "f7bb595ab1fb2640064f7bb99a6717182cbf232df3babe630366c360a43153e7",
    "RETRY": "3ef3e0c13b12c3ffd07586db110ffd5f815870fa265039ba6ce431f104d8013d",
}


@pytest.mark.parametrize("name", TEMPLATE_SHA256)
def test_template_wording(name):
    assert hashlib.sha256(getattr(prompts, name).encode()).hexdigest() == TEMPLATE_SHA256[name]


def test_perceptor_prompts(spark):
    line = prompts.region_line(
        F.lit("one"), F.lit(10), F.lit(20), F.lit(4096), F.lit(4096), F.lit("physical"), F.lit(5),
        F.lit("unknown"),
    )
    made = values(spark, lambda c: prompts.perceptor_prompt(prompts.CONTEXT, line, F.lit("Which?"), c),
                  [None, "", "核分裂\nmore"])
    start = ("Region=one; Original-pixel bounds=(10,20,4096,4096); Magnification=5x; Scale source=unknown\n"
             "Please describe the pathology features related to the question: Which? in this image.")
    assert made == [start, start, start + "\nMissing visual information to inspect: 核分裂\nmore"]
    plain = values(spark, lambda c: prompts.perceptor_prompt(prompts.PAPER, line, None, c), ["x"])
    assert plain == [prompts.GENERIC]


def test_messages_are_json(spark):
    made = values(spark, lambda c: prompts.messages("sys", c, retry=True), ['a "b"\nc'])
    assert json.loads(made[0]) == [
        {"role": "system", "content": "sys"}, {"role": "user", "content": 'a "b"\nc'},
        {"role": "user", "content": prompts.RETRY},
    ]


def test_patch_lines(spark):
    names = ["37856_28960.jpg", "a/1_2.png", "1_2_3.jpg", "x.jpg"]
    made = values(spark, lambda c: prompts.patch_line(c, F.lit("d")), names)
    assert made == [
        "[37856_28960.jpg | Coord=(37856,28960)] d", "[a/1_2.png | Coord=(1,2)] d",
        "[1_2_3.jpg | Coord=(unknown)] d", "[x.jpg | Coord=(unknown)] d",
    ]
