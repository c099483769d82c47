import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesserae.sources import annotations, descriptions, files, inventory


def test_slide_csv_ignores_predictions_and_bom(spark, tmp_path):
    path = tmp_path / "cohorts.csv"
    head = "ID,Slide,Tumor,Task,Question,A,B,C,D,Answer,Output\n"
    path.write_text("﻿" + head + '1, slide ,LUAD,,"Which\none, ""x""?",one,two,,,A,RELEASED_PREDICTION\n', encoding="utf-8")
    row = annotations.read_slide_qa_csv(spark, str(path), "d", cohorts=True).first()
    assert (row.sample_id, row.image_id, row.task, row.source) == ("d:1", "slide", "Tumor subtype", "LUAD")
    assert row.question == 'Which\none, "x"?' and row.ground_truth_label == "A"
    assert "RELEASED" not in str(row) and [c.label for c in row.choices] == ["A", "B"]


def nested(**extra):
    row = {"No": 1, "img": "a.jpg", "question": "q?", "options": ["A) x", "B) y"], "answer": "B) y"}
    return {"S": {"test": [row, {**row, "No": 2, "options": []}], "test_tiny": [{**row, "question": "another?"}], **extra}}


def test_nested_json(spark, tmp_path):
    path = tmp_path / "data.json"
    path.write_text(json.dumps(nested(), indent=1))
    rows = annotations.read_nested_qa_json(spark, str(path), ["S"], ["test", "test_tiny"]).collect()
    assert {r.sample_id: r.ground_truth_label for r in rows} == {
        "nested:S:test:1": "B", "nested:S:test:2": None, "nested:S:test_tiny:1": "B"}
    assert all(r.input_kind == "roi" for r in rows)
    with pytest.raises(ValueError, match="T/test"):
        annotations.read_nested_qa_json(spark, str(path), ["S", "T"], ["test"])
    with pytest.raises(ValueError, match="S/val"):
        annotations.read_nested_qa_json(spark, str(path), ["S"], ["val"])


def test_case_json(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"Id": "c1", "Question": "q", "Answer": "free"},
                                {"Id": "c2", "Question": "q", "Choice": ["yes", "no"], "Answer": "no"}]))
    slide_map = spark.createDataFrame([("c2", "x/slide.v1.svs")], "case_id string, slide_file string")
    rows = {r.sample_id: r for r in annotations.read_case_qa_json(spark, str(path), slide_map, "/root").collect()}
    assert (rows["cases:0"].image_id, rows["cases:0"].image_path, rows["cases:0"].ground_truth_label) == ("c1", "", None)
    assert (rows["cases:1"].image_id, rows["cases:1"].image_path) == ("slide.v1", "/root/x/slide.v1.svs")
    assert rows["cases:1"].ground_truth_label == "B"
    with pytest.raises(ValueError, match="without a slide"):
        annotations.read_case_qa_json(spark, str(path), slide_map, require_images=True)


def test_files(spark, tmp_path):
    for name, content in {"a/x.SVS": b"1", "b/x.svs": b"22", "b/y.tar.png": b"333", "b/z.txt": b"4"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listing = files.list_files(spark, str(tmp_path))
    found = sorted((r.image_id, r.path.rsplit("/", 2)[1]) for r in files.image_index(listing).collect())
    assert found == [("x", "a"), ("x", "b"), ("y.tar", "b")]
    hashed = {r.path.rsplit("/", 1)[1]: r for r in files.hash_files(files.read_files(spark, str(tmp_path))).collect()}
    assert hashed["y.tar.png"].sha256 == hashlib.sha256(b"333").hexdigest() and hashed["y.tar.png"].size == 3
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_inventory(spark, tmp_path):
    path = tmp_path / "inventory.csv"
    path.write_text('/p/a.svs,a.svs,file,12,t,rw\n/p/d,d,directory\n"/p/q,1.svs",q.svs,symbolic_link,99,rwx,file,x,/t, file ,7,file,8\n'
                    "/p/n.svs,n.svs,file,unknown\n/p/l.svs,l.svs,symbolic_link,file\n")
    rows = {r.path: (r.type, r.size) for r in inventory.read_inventory(spark, str(path)).collect()}
    assert rows == {"/p/a.svs": ("file", "12"), "/p/d": ("directory", ""), "/p/q,1.svs": ("symbolic_link", "7"),
                    "/p/n.svs": ("file", ""), "/p/l.svs": ("symbolic_link", "")}


def test_descriptions_later_file_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"s": {"p": "old", "q": "kept"}}))
    (tmp_path / "b.json").write_text(json.dumps({"s": {"p": "new"}, "t": {"p": "x"}}, indent=1))
    (tmp_path / "c.json").write_text('{"s": {"p": "brok')
    for i, tail in enumerate([" garbage", "]", "}", "] x", "} x", ', {"s": {}}']):
        (tmp_path / f"d{i}.json").write_text('{"s": {"p": "followed"}}' + tail)
    rows = descriptions.read_descriptions(spark, str(tmp_path)).collect()
    assert {(r.slide, r.patch): r.text for r in rows} == {("s", "p"): "new", ("s", "q"): "kept", ("t", "p"): "x"}
    texts = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    assert sorted(r.file for r in descriptions.unreadable(texts).collect()) == ["c.json", *(f"d{i}.json" for i in range(6))]


def test_unsafe_or_ambiguous_mappings(spark):
    mapping = spark.createDataFrame([("k1", "a", "o"), ("k1", "b", "o"), ("k2", "d/e", "o"), ("k3", "f", "o")], "key string, name string, original string")
    assert {r.key for r in files.unsafe_or_ambiguous(mapping, "key").collect()} == {"k1", "k2"}


def test_inventory_forms(spark):
    def parse(*lines):
        df = spark.createDataFrame([(x,) for x in lines], "value string")
        return {r.path: (r.type, r.size) for r in inventory.parse_inventory(df).collect()}

    link = "b,b,symbolic_link,12,m,r,t,file,99"
    assert parse("a,a, file ,5", link) == {"a": ("file", "5"), "b": ("symbolic_link", "99")}
    # With a header the named cells count.
    assert parse("path,basename,type,size,mtime", "a,a, file ,5", link) == {
        "a": (" file ", "5"), "b": ("symbolic_link", "12")}
    many = ",".join(f'"c{i}, ""x"""' for i in range(8000))
    cells = spark.createDataFrame([(many,)], "v string").select(inventory.csv_cells(F.col("v")).alias("c")).first().c
    assert len(cells) == 8000 and cells[-1] == 'c7999, "x"'
    assert parse('p,,file,"7",') == {"p": ("file", "7")}


def test_malformed_inventory_is_an_error(spark, tmp_path):
    for i, text in enumerate(["a,b\n", 'a,"b\nc",file,1\n']):
        path = tmp_path / f"{i}.csv"
        path.write_text(text)
        with pytest.raises(ValueError, match="malformed"):
            inventory.read_inventory(spark, str(path))
