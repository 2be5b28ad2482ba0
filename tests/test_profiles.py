"""Bounded aggregates, sampled types, suggested preprocessing, XML by events, JSON5."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamwork.operators import bounded, infer, nested, preprocess, profile
from loamwork.sources import documents, xml_events


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def wide(spark):
    """Few, some and many distinct values; nulls, blanks, a column of nothing, a hot value, a name with a dot."""
    i = F.col("id")
    return spark.range(3000, numPartitions=5).select((i % 3).alias("few"), F.when(i % 4 > 0, i % 40).alias("some"), i.cast("string").alias("many"), F.lit(None).cast("string").alias("none"), F.when(i % 3 == 0, "").otherwise("hot").alias("a.b"), (i % 99).alias("value"))


@pytest.mark.parametrize("cap", [2, 3, 30, 100, 5000])
def test_distinct_values_are_exact_up_to_the_cap(wide, cap):
    n = {r["column"]: r.n_distinct for r in profile.counts(wide).collect()}
    for df in (wide, wide.repartition(11), wide.coalesce(1)):
        got = {r["column"]: (r.n_distinct, r.capped) for r in bounded.distinct_up_to(df, cap=cap).collect()}
        assert got == {c: (None, True) if k > cap else (k, False) for c, k in n.items()}


def test_tasks_give_no_more_than_the_cap(wide):
    found = bounded._found(wide, ["many", "few"], 50, 0, values=True)
    assert found.where("value is not null").groupBy("column").count().agg(F.max("count")).first()[0] <= 5 * 50
    assert bounded._found(wide, ["many"], 50, 0, values=False).where("value is not null").isEmpty()


def test_samples_are_seeded_whole_and_the_same_however_stored(wide):
    rows = [r.asDict() for r in wide.collect()]
    for k, seed in ((7, 0), (45, 3)):
        want = []
        for c in wide.columns:
            counts = Counter(None if r[c] is None else str(r[c]) for r in rows)
            picked = sorted((v for v in counts if v is not None), key=lambda v: (bounded.value_hash(v, seed), v))[:k]
            want += [(c, v, counts[v]) for v in [*picked, *([None] if counts[None] else [])]]
        for df in (wide, wide.repartition(9)):
            assert rows_of(bounded.samples(df, k=k, seed=seed)) == sorted(want, key=repr)


def test_wide_tables_take_several_passes(wide, monkeypatch):
    monkeypatch.setattr(bounded, "HELD", 100)
    assert rows_of(bounded.distinct_up_to(wide, cap=40)) == rows_of(profile.counts(wide).select("column", F.when(F.col("n_distinct") <= 40, F.col("n_distinct")), F.col("n_distinct") > 40))


def test_empty_tables_have_a_row_a_column(spark, wide):
    none = wide.limit(0)
    assert rows_of(bounded.distinct_up_to(none)) == sorted(((c, 0, False) for c in wide.columns), key=repr)
    assert bounded.samples(none).collect() == []
    for types in (infer.strict_types(none), infer.threshold_types(none), infer.scored_types(none), infer.threshold_types(none, sample=5)):
        assert {r["column"]: r.type for r in types.collect()} == dict.fromkeys(wide.columns, "string")


def test_types_of_a_sample(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("n"), F.when(F.col("id") == 1999, "x").otherwise(F.date_format(F.timestamp_seconds(F.col("id") * 86400), "yyyy-MM-dd")).alias("d"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"))
    assert {r["column"]: r.type for r in infer.threshold_types(df, sample=200).collect()} == {r["column"]: r.type for r in infer.threshold_types(df).collect()} == {"n": "int32", "d": "date", "t": "lowcard_string"}
    assert {r["column"]: r.type for r in infer.strict_types(df, sample=5000).collect()} == {r["column"]: r.type for r in infer.strict_types(df).collect()}


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(" a ", "+7 (900) 000-00-01", "N/A", 1), ("b", "8 900 000 00 02", "x", 2), ("NULL", None, "", 3), (None, "N/A", "y z", 4), ("\tc\n", "+7 900 0000003", "y", 5)]
    return spark.createDataFrame(rows, "name string, phone string, note string, n int")


def test_steps_are_suggested_and_applied(messy):
    steps = preprocess.suggested(messy)
    assert steps == {"name": {"trim": True, "null_if": ["NULL"]}, "phone": {"null_if": ["N/A"], "regex_replace": [{"pattern": r"\D+", "repl": ""}]}, "note": {"null_if": ["", "N/A"]}}
    assert rows_of(preprocess.applied(messy, steps)) == sorted([("a", "79000000001", None, 1), ("b", "89000000002", "x", 2), (None, None, None, 3), (None, None, "y z", 4), ("c", "79000000003", "y", 5)], key=repr)
    assert preprocess.suggested(preprocess.applied(messy, steps)) == {} or "regex_replace" in preprocess.suggested(preprocess.applied(messy, steps)).get("phone", {})
    assert preprocess.suggested(messy.limit(0)) == {}


def test_steps_keep_their_order_and_are_checked(messy):
    doc = {"note": {"regex_replace": [{"pattern": "[xyz]", "repl": ""}, {"pattern": " ", "repl": ""}], "null_if": [""]}}
    assert [r.note for r in preprocess.applied(messy, doc).orderBy("n").collect()] == ["N/A", None, None, None, None]
    assert preprocess.Steps.from_json(doc["note"]).to_json() == doc["note"]
    assert preprocess.lint({"no": {}, "note": {"upper": 1, "null_if": [1], "regex_replace": [{"pattern": "("}, {}]}}, messy.columns)[0] == "no: no such column"
    assert len(preprocess.lint({"note": {"upper": 1, "null_if": [1], "regex_replace": [{"pattern": "("}, {}]}}, messy.columns)) == 4
    with pytest.raises(ValueError, match="no such column"):
        preprocess.applied(messy, {"no": {"trim": True}})
    assert preprocess.applied(messy, {"n": {"null_if": ["3"]}}).dtypes[3] == ("n", "string")


XML = """<?xml version="1.0"?><!-- <x> --><r:root xmlns:r="u" xmlns="v" r:id="1"><item k="1"><a/><a>t</a></item>
<r:item j="2" xml:lang="e">mixed <b><![CDATA[</item>]]></b> more</r:item><item/><other>&lt;</other></r:root>"""


def test_events_of_a_literal_document(spark):
    found = xml_events.sums(spark.createDataFrame([(XML,), ("<bad>",), (None,), ("",), ("<root><item><a/></item></root>",)], "text string"))
    assert rows_of(xml_events.elements(found)) == sorted([("/root", 2, ["id"], 0, False), ("/root/item", 4, ["j", "k", "lang"], 1, True), ("/root/item/a", 3, [], 1, False), ("/root/item/b", 1, [], 1, False), ("/root/other", 1, [], 1, False)], key=repr)
    assert rows_of(xml_events.edges(found)) == sorted([("/root", "item", 1, 3, 2, True), ("/root", "other", 0, 1, 1, False), ("/root/item", "a", 0, 2, 2, True), ("/root/item", "b", 0, 1, 1, False)], key=repr)
    assert xml_events.broken(found) == 1


def test_records_of_a_file_in_many_ranges(spark, tmp_path):
    text = '<?xml version="1.0"?>\n<all>' + "".join(f'<rec id="{i}"><v>{"x" * (i % 50)}</v>{"<w/>" * (i % 3)}</rec>\n' for i in range(2000)) + "<tail>1</tail></all>"
    (tmp_path / "f.xml").write_text(text)
    keys = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        records = xml_events.records(spark, f"file://{tmp_path}/f.xml", "rec")
        assert records.rdd.getNumPartitions() > 10 and records.count() == 2000
        found = xml_events.sums(records)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows_of(xml_events.edges(found, "/all")) == [("/all/rec", "v", 1, 1, 2000, False), ("/all/rec", "w", 0, 2, 1333, True)]
    assert {r.path: r.n for r in xml_events.elements(found, "/all").collect()} == {"/all/rec": 2000, "/all/rec/v": 2000, "/all/rec/w": 1999}


def test_edges_without_elements_below(spark):
    df = spark.sql("SELECT named_struct('_id', 1, '_value', 'x') AS record")
    assert nested.edges(df).collect() == []


def test_json5_where_it_is_no_json():
    parse = documents.parse_dirty
    assert parse("{'a': 1}") == {"a": 1} and parse("noise {a: 'it\\'s \"q\"', b: [+1, .5, 0x1F, 2.,], /* c */ $c: null,} end") == {"a": 'it\'s "q"', "b": [1, 0.5, 31, 2.0], "$c": None}
    assert parse('{"a": "it\'s {fine}"}') == {"a": "it's {fine}"} and parse("{'x': NaN, 'y': -Infinity, z: true}") == {"x": None, "y": None, "z": True}
    assert parse("{'}': ']'}") == {"}": "]"} and parse("{oops") is None and parse(None) is None and parse("{'a' 1}") is None


def test_extended_fields_leave_nothing_out(spark):
    from loamwork.operators import model

    found = xml_events.sums(spark.createDataFrame([(XML,)], "text string"))
    edges, about = ([r.asDict() for r in df.collect()] for df in (xml_events.edges(found), xml_events.elements(found)))
    plain, full = model.entity_fields(edges, "/root"), model.entity_fields(edges, "/root", about)
    assert {e: sorted(x["fields"]) for e, x in plain.items()} == {"/root": ["other"], "/root/item": ["b"], "/root/item/a": []}
    assert {e: sorted(x["fields"]) for e, x in full.items()} == {"/root": ["@id", "other"], "/root/item": ["#text", "@j", "@k", "@lang", "b"], "/root/item/a": ["#text"]}


def test_scratch_tables_of_a_scope_go(spark):
    from loamwork.plans import scratch

    with scratch.scope():
        inner = scratch.materialise(spark.range(3).toDF("id"), "gone")
        with scratch.scope():
            scratch.materialise(spark.range(3).toDF("id"), "gone-too")
        assert inner.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(inner._loamwork_path).count()
    kept = scratch.materialise(spark.range(3).toDF("id"), "kept")
    assert kept.count() == 3 and spark.conf.get(scratch._CLEAN, "false") == "false"
    scratch.release(kept)
