"""Arrays over many ranges, payloads by key, links that the markup numbers."""

import json
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tesserae.sources import arrays
from tesserae.runtime import scratch_path
from tesserae.sources import annotations, files, payloads
from tesserae.sources.arrays import ends, json_elements


def odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice('a,b"\\[]{}: \n\té😀') for _ in range(rng.randrange(30)))
    if kind == 1:
        return rng.choice([1, -2.5, True, None])
    if kind in (2, 3):
        return "x" * rng.randrange(60)
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i},{i}": odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(spark, path, size):
    """Elements read in ranges of ``size`` bytes, and how many tasks read the file."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in zip(names, (str(size), "0", "64"), strict=True):
        spark.conf.set(name, value)
    try:
        tasks = spark.read.text(path, lineSep=",").rdd.getNumPartitions()
        rows = json_elements(spark, path).orderBy("position").collect()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return rows, tasks


@pytest.mark.parametrize("size,indent", [(40, None), (400, None), (97, 1), (1 << 20, None)])
def test_elements_of_any_cut(spark, tmp_path, size, indent):
    rng = random.Random(size)
    values = [odd_value(rng) for _ in range(120)]
    path = tmp_path / "array.json"
    path.write_text("﻿ \n" + json.dumps(values, ensure_ascii=False, indent=indent) + "\n", encoding="utf-8")
    rows, tasks = elements(spark, str(path), size)
    assert [r.position for r in rows] == list(range(len(values)))
    assert [json.loads(r.element) for r in rows] == values
    assert tasks > 20 or size > 100


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    text = 'said: "one, two" \\ three'
    with open(path, "w") as out:
        out.write("[" + ",".join(json.dumps({"Id": i, "Question": f"{text} {i}", "Answer": "a"}) for i in range(60_000)) + "]")
    rows, tasks = elements(spark, str(path), 200_000)
    assert tasks > 10 and len(rows) == 60_000
    assert all(json.loads(rows[i].element) == {"Id": i, "Question": f"{text} {i}", "Answer": "a"} for i in range(0, 60_000, 997))


def test_what_is_no_array_is_refused(spark, tmp_path):
    for i, (text, words) in enumerate([('[1, 2', "end"), ('["a, 2]', "end"), ('{"a": 1, "b": 2}', "no JSON array"), ("[1,,2]", "too many"), ("[1]]", "end")]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises((ValueError, SparkRuntimeException), match=words):
            json_elements(spark, str(path)).count()
    empty = tmp_path / "empty.json"
    empty.write_text(" [ \n] ")
    assert json_elements(spark, str(empty)).count() == 0
    single = tmp_path / "single.json"
    single.write_text('[{"a": [1, 2]}]')
    assert [r.element for r in json_elements(spark, str(single)).collect()] == ['{"a": [1, 2]}']


def test_pieces_end_where_strings_do():
    assert ends('{"a": "b') == ((True, 1), (False, 0))
    assert ends(r'c\"d"}') == ((True, 0), (False, -1))
    assert ends("[[") == ((False, 2), (True, 0))


def test_equal_questions_are_refused(spark, tmp_path):
    row = {"No": 1, "img": "a.jpg", "question": "q?", "options": ["A) x", "B) y"], "answer": "B) y"}
    other = {**row, "No": 2, "question": "other?"}
    path = tmp_path / "twice.json"
    path.write_text(json.dumps({"S": {"test": [row, other], "test_tiny": [{**row, "No": 3}]}}))
    with pytest.raises(ValueError, match="repeated question"):
        annotations.read_nested_qa_json(spark, str(path), ["S"], ["test", "test_tiny"])
    rows = spark.createDataFrame(
        [("S", "t", "1", "i", "q", ["a, b"]), ("S", "t", "2", "i", "q", ["a", "b"]), ("S", "t", "3", "i", "q", None),
         ("S", "u", "4", "i", "q", []), ("T", "t", "1", "i", "q", ["a, b"])],
        "source string, split string, No string, img string, question string, options array<string>")
    assert [(r.rows, r.first) for r in annotations.repeated_questions(rows).collect()] == [(2, "S/t/3")]


def payload_table(spark, rows, path):
    spark.createDataFrame(rows, "filename string, image struct<path: string, bytes: binary>, extra string").write.parquet(path)
    return path


def mapped(spark, *names):
    rows = [(f"img_{n}", f"pre/x/{n}.jpg") for n in names]
    return payloads.mapping_of(spark.createDataFrame(rows, "img string, source_img string"), "img", "source_img", "pre")


def test_payloads_are_restored_by_key(spark):
    path = payload_table(spark, [(f"{n}.jpg", (f"a/b/{n}.jpg", n.encode() * 3), "z") for n in "abcdefgh"], scratch_path(spark, "images"))
    present = spark.createDataFrame([("img_b",)], "name string")
    for key, nested in (("filename", False), ("image.path", True)):
        store = scratch_path(spark, "store")
        report = payloads.restore_payloads(spark, [path], mapped(spark, "a", "b", "c", "zz"), store, present, key, as_base_name=nested)
        assert {r.name: (r.status, r.size) for r in report.collect()} == {
            "img_a": ("restored", 3), "img_b": ("already_present", None), "img_c": ("restored", 3), "img_zz": ("missing", None)}
        assert {r.name: bytes(r.content) for r in payloads.stored(spark, store).collect()} == {"img_a": b"aaa", "img_c": b"ccc"}
        # The same batch again replaces itself.
        payloads.restore_payloads(spark, [path], mapped(spark, "a", "c"), store, None, key, as_base_name=nested)
        assert payloads.stored(spark, store).count() == 2


def test_duplicates_and_empty_payloads_are_errors(spark):
    rows = [("a.jpg", ("a.jpg", b"1"), ""), ("a.jpg", ("a.jpg", b"1"), ""), ("b.jpg", ("b.jpg", b""), ""), ("c.jpg", ("c.jpg", None), "")]
    path = payload_table(spark, rows, scratch_path(spark, "images"))
    with pytest.raises(ValueError, match="duplicate"):
        payloads.restore_payloads(spark, [path], mapped(spark, "a"), scratch_path(spark, "store"))
    with pytest.raises(ValueError, match="no payload"):
        payloads.restore_payloads(spark, [path], mapped(spark, "b"), scratch_path(spark, "store"))
    store = scratch_path(spark, "store")
    report = payloads.restore_payloads(spark, [path], mapped(spark, "a", "b", "c"), store, strict=False)
    assert {r.name: r.status for r in report.collect()} == {"img_a": "duplicate", "img_b": "empty", "img_c": "empty"}
    odd = spark.createDataFrame([("x", "pre/a/n.jpg"), ("y", "pre/b/n.jpg")], "img string, source_img string")
    with pytest.raises(ValueError, match="ambiguous"):
        payloads.mapping_of(odd, "img", "source_img", "pre")


def test_scans_read_what_they_need(spark):
    path = payload_table(spark, [(f"{i:03}.jpg", (f"{i:03}.jpg", b"x"), "z") for i in range(50)], scratch_path(spark, "images"))
    tables, mapping = spark.read.parquet(path), mapped(spark, "007", "009")
    first = payloads.key_counts(tables, mapping, "image.path", True)
    assert "ReadSchema: struct<image:struct<path:string>>" in first._jdf.queryExecution().executedPlan().toString()
    wanted = payloads.key_counts(tables, mapping).join(mapping, "key")
    second = payloads.payload_rows(tables, wanted, "filename", "image.bytes")
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<filename:string,image:struct<bytes:binary>>" in plan
    assert "GreaterThanOrEqual(filename,007.jpg)" in plan and "LessThanOrEqual(filename,009.jpg)" in plan


def test_links_by_the_index_of_the_markup(spark):
    page = 'm:0="u0" m:3="u3" m:0="u0" '
    pages = spark.createDataFrame([(1, page), (2, 'm:1="x" m:1="y" m:0="z"'), (3, "none"), (4, None)], "page int, html string")
    links = files.indexed_links(pages, "page", "html", r'm:(\d+)="([^"]*)"')
    assert {(r.page, r["index"], r.url, r.urls) for r in links.collect()} == {(1, 0, "u0", 1), (1, 3, "u3", 1), (2, 0, "z", 1), (2, 1, None, 2)}
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (3, 1), (9, 1)], "page int, position bigint")
    found = {(r.page, r.position): (r.url, r.status, r.exposed) for r in files.pick_indexed(links, wanted, "page").collect()}
    assert found == {(1, 1): ("u0", "found", 2), (1, 2): (None, "missing", 2), (1, 4): ("u3", "found", 2),
                     (2, 1): (None, "conflict", 2), (3, 1): (None, "missing", 0), (9, 1): (None, "missing", 0)}


def test_files_of_one_range_are_read_once(spark, tmp_path, monkeypatch):
    def refuse(batches):
        raise AssertionError("read for its start")

    monkeypatch.setattr(arrays, "_summaries", lambda batches: (refuse(b) for b in batches))
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"Id": f"{i}, {j}"} for j in range(4)]))
    rows = json_elements(spark, str(tmp_path)).collect()
    found = {(r.file[-6:], r.position, r.element) for r in rows}
    assert found == {(f"{i}.json", j, json.dumps({"Id": f"{i}, {j}"})) for i in range(3) for j in range(4)}
