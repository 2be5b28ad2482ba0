"""Files in many splits: delimited text with line breaks, one large JSON array, XML by events."""

import csv
import io
import json
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from loamwork.sources import delimited, documents, json_splits, multiline


@pytest.fixture
def small_splits(spark):
    """Splits of about 2 kB, whatever the file's size."""
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def messy_cells(n=1500, seed=1):
    draw = random.Random(seed)
    odd = ["plain", 'two\nlines', 'a "quoted" word', ",", 'x\n\n"y",\nz', "", " padded ", 'long ' * 200 + "\nend", "é\n😀", '"', "\r\nwin"]
    return [[str(i), draw.choice(odd), draw.choice(odd)] for i in range(n)]


def as_csv(rows, **how):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", **how).writerows(rows)
    return out.getvalue()


def test_cells_span_lines_and_splits(spark, tmp_path, small_splits):
    rows = messy_cells()
    (tmp_path / "f.csv").write_bytes(as_csv([["id", "a\nb", "c"], *rows]).encode())
    path = f"file://{tmp_path}/f.csv"
    df = delimited.read(spark, path)
    assert df.columns == ["id", "a\nb", "c"]
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, a or None, c or None) for i, a, c in rows)
    begins = multiline.splits(spark, path)
    assert len(begins) > 50 and any(inside for _, inside in begins.values())
    assert spark.read.text(path).rdd.getNumPartitions() == multiline.records(spark, path, {k: (n, False) for k, (n, _) in begins.items()}).rdd.getNumPartitions() > 50


def test_stray_quotes_open_no_cell(spark, tmp_path, small_splits):
    text = "id,size\n" + "".join(f'{i},{i % 9}" pipe\n' if i % 7 == 0 else f"{i},x\n" for i in range(2000))
    (tmp_path / "s.csv").write_text(text)
    path = f"file://{tmp_path}/s.csv"
    assert multiline.splits(spark, path) is None
    df = delimited.read(spark, path)
    assert df.rdd.getNumPartitions() == spark.read.text(path).rdd.getNumPartitions() > 5
    assert sorted((int(r.id), r.size) for r in df.collect()) == [(i, f'{i % 9}" pipe' if i % 7 == 0 else "x") for i in range(2000)]


def test_many_files_each_with_a_header(spark, tmp_path, small_splits):
    rows = messy_cells(600, 2)
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.csv").write_bytes("﻿".encode() * (k == 0) + as_csv([["id", "a", "b"], *rows[k::3]], delimiter=";").encode())
    df = delimited.read(spark, f"file://{tmp_path}/many")
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, a or None, b or None) for i, a, b in rows)


def test_encodings_are_detected_though_the_rest_is_given(spark, tmp_path):
    for name, text in (("one", "a;b\nпривет;1\n"), ("two", 'a;b\n"при\nвет";1\n')):
        (tmp_path / name).write_bytes(text.encode("cp1251"))
        rows = delimited.read(spark, f"file://{tmp_path}/{name}", ["a", "b"], ";", True).collect()
        assert [(r.a.replace("\n", ""), r.b) for r in rows] == [("привет", "1")]


def test_short_long_and_empty_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1\n\n"2\n2",x,more\n3,\n')
    rows = delimited.read(spark, f"file://{tmp_path}/r.csv", corrupt="_bad").collect()
    assert [(r.a, r.b) for r in rows] == [("1", None), ("2\n2", "x"), ("3", None)]
    assert [r._bad is not None for r in rows] == [True, True, False]
    (tmp_path / "empty.csv").write_text("")
    assert delimited.read(spark, f"file://{tmp_path}/empty.csv", ["a"], ",", True).collect() == []


ODD = ["", None, "x\ry", "\r", "nul\0", 'nul\0, "quoted"', "end\uffff", "\ufffe1\uffff0\ufffe"]


@pytest.mark.parametrize("cells", [["end\uffff", "b"], [*ODD, "plain"], [*ODD, "two\nlines"]])
def test_cells_that_spark_wrote_come_back(spark, tmp_path, cells):
    rows = [(str(i), a, b) for i, (a, b) in enumerate(product(cells, repeat=2))]
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    spark.createDataFrame(rows, "id string, a string, b string").write.options(**keep).csv(f"file://{tmp_path}/csv")
    assert sorted(map(tuple, delimited.read(spark, f"file://{tmp_path}/csv", delimiter=",").collect()), key=repr) == sorted(rows, key=repr)


def test_what_stands_within_quotes():
    q = multiline.Quotes()
    assert [q.hold(x, False, b"\r") for x in (b'"a\r"', b'a\r,"b"', b'a,"b""\r",c', b'"a","b"\r', b'"a"\r,"\r', b"\r", b'a"\r"')] == [True, False, True, False, True, False, False]
    assert [q.hold(x, True, b"\r") for x in (b"\r", b'a"\r', b'a","\r"', b'""\r"')] == [True, False, True, True]


def test_a_quote_that_never_closes(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text('a,b\n1,"never\n' + "".join(f"{i},x\n" for i in range(3000)))
    path = f"file://{tmp_path}/open.csv"
    begins = multiline.splits(spark, path)
    assert multiline.records(spark, path, begins, header=True).count() == 1
    with pytest.raises(Exception, match="not closed"):
        multiline.records(spark, path, begins, header=True, longest=1000).collect()


def test_other_splits_than_those_looked_at_are_refused(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(as_csv(messy_cells(300)).encode())
    path = f"file://{tmp_path}/f.csv"
    begins = multiline.splits(spark, path)
    with pytest.raises(Exception, match="splits"):
        multiline.records(spark, path, {k: (n + 1, x) for k, (n, x) in begins.items()}).collect()


def test_a_line_is_a_function_of_how_it_begins():
    q = multiline.Quotes(";")
    assert [q.after(x, False) for x in (b'a;"b', b'"a"";', b'a"b;"', b'"a";"b";c', b'"a"x;"b', b"", b'a;""', b'"""')] == [True, True, True, False, True, False, False, True]
    assert [q.after(x, True) for x in (b"a", b'a"', b'a";"', b'a"";', b'a";b', b'"')] == [True, False, True, True, False, False]


def test_the_first_records_need_no_pass(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes(as_csv([["id", "a", "b"], *messy_cells(500)]).encode())
    assert [r.id for r in delimited.sample(spark, f"file://{tmp_path}/f.csv", 7).collect()] == [str(i) for i in range(7)]


def records(n, seed=3):
    draw = random.Random(seed)
    odd = ["plain", '}, {"', "[[", 'a \\ b', '\\"', "é😀\n", "]", ""]
    return [{"i": i, "t": draw.choice(odd) * draw.randrange(3), "deep": [{"x": [1, {"y": draw.choice(odd)}]}, []], "big": "z" * draw.choice([0, 10, 6000])} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_an_array_in_many_splits(spark, tmp_path, small_splits, indent):
    rows = records(400)
    rows[7], rows[8], rows[9], rows[10] = 5, "text, ]", [1, [2, {}]], None
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    path = f"file://{tmp_path}/a.json"
    found = documents.json_array(spark, path).select("rec_id", F.to_json("value").alias("v")).collect()
    assert sorted((r.rec_id, json.loads(r.v)) for r in found if r.rec_id not in (8, 9, 10, 11)) == [(i + 1, x) for i, x in enumerate(rows) if i not in (7, 8, 9, 10)]
    assert {r.rec_id: json.loads(r.v) for r in found if 8 <= r.rec_id <= 11} == {8: 5, 9: "text, ]", 10: [1, [2, {}]], 11: None}
    known = json_splits.begins(spark, path, [])
    assert len(known) > 50 and any(x[2] for x in known.values())
    assert json_splits.elements(spark, path, known).count() == 400


def test_an_array_under_keys_and_none(spark, tmp_path, small_splits):
    rows = records(200)
    (tmp_path / "b.json").write_text(json.dumps({"rows": 1, "other": {"rows": [7]}, "data": {"n": [1], "rows": rows, "z": [1, 2, [3]]}, "end": [{}] * 300}))
    found = documents.json_array(spark, f"file://{tmp_path}/b.json", "data.rows").select("rec_id", F.to_json("value").alias("v")).collect()
    assert sorted((r.rec_id, json.loads(r.v)) for r in found) == [(i + 1, x) for i, x in enumerate(rows)]
    assert documents.json_array(spark, f"file://{tmp_path}/b.json", "data.none").collect() == []
    for k, text in enumerate(("[]", " [ ] ", "[1]", '[{"a": 1}]', '[{"a": "}"},2]')):
        (tmp_path / f"c{k}.json").write_text(text)
        found = documents.json_array(spark, f"file://{tmp_path}/c{k}.json").select("rec_id", F.to_json("value").alias("v")).collect()
        assert sorted((r.rec_id, json.loads(r.v)) for r in found) == list(enumerate(json.loads(text), 1))


def test_places_go_on_from_file_to_file(spark, tmp_path, small_splits):
    (tmp_path / "on").mkdir()
    parts = [records(40, 1), [], records(3, 2), records(90, 3)]
    for k, rows in enumerate(parts):
        (tmp_path / "on" / f"{k}.json").write_text(json.dumps({"data": rows, "other": [[1, 2], [3, 4], 5, 6]}))
    found = documents.json_array(spark, f"file://{tmp_path}/on", "data", through=True).select("rec_id", F.to_json("value").alias("v")).collect()
    assert sorted((r.rec_id, json.loads(r.v)) for r in found) == list(enumerate(sum(parts, []), 1))


def test_no_task_writes_all_events(spark, tmp_path, monkeypatch):
    """json_array_splits writes a file for each range of ids, and numbers their elements through."""
    from loamwork import queries

    monkeypatch.setattr(queries, "IDS_A_FILE", 400)
    monkeypatch.setattr(queries, "_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    found = queries.json_array_splits(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type").collect()
    assert sorted((r.rec_id, r.user_id, r.event_type) for r in found.collect()) == sorted(map(tuple, rows))
    assert len(list((tmp_path / "json").glob("part-*"))) == -(-len(rows) // 400)


def test_arrays_of_many_files_are_numbered_each(spark, tmp_path, small_splits):
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.json").write_text(json.dumps(records(40 + k, k)))
    found = documents.json_array(spark, f"file://{tmp_path}/many").groupBy("rec_id").count().collect()
    assert {r.rec_id: r["count"] for r in found} == {i: 3 - (i > 40) - (i > 41) for i in range(1, 43)}


def test_where_an_array_begins():
    f = json_splits.array_start
    assert f(b' [1]', []) == 2 and f(b'{"a": [1]}', []) is None and f(b'{"a": [1]}', ["a"]) == 7 and f(b'{"b": {"a": [1]}, "a": {"x": 1}}', ["a"]) is None
    assert f(b'{"b": {"a": [1]}, "a": [2]}', ["a"]) == 24 and f(b'{"x": "a", "a": {"a": [', ["a", "a"]) == 23 and f(b'{"x": [{"a": [1]}]}', ["a"]) is None
