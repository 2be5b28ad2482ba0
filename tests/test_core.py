"""Core operators on small fixtures: tokens, routing, nested data, sources, models, DDL, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loamwork.functions import tokens, types
from loamwork.operators import infer, model, nested, profile, quality, routing
from loamwork.plans import ddl, scratch
from loamwork.sources import delimited, documents, tables

ORDERS = "order_id,user_id,user_email,user_name,order_ts,amount\n1,1,a@x.io,Ann,2025-01-01T10:00:00Z,10.50\n2,2,b@x.io,Bob,2025-01-02T10:00:00Z,20\n3,1,a@x.io,Ann,2025-01-03T10:00:00Z,5.25\n"
STOCK = "sku,warehouse_id,qty\nP100,101,150\nP100,101,155\nP200,101,7\nP200,102,NULL\n"


def _texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def _column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_null_tokens(spark):
    df = _texts(spark, " NULL ", "N/A", "nan", "", "\\n", "0", None)
    assert _column(df, tokens.cleaned(F.col("t"))) == [None, None, None, None, None, "0", None]


def test_bools(spark):
    df = _texts(spark, "Да", "нет", "Y", "maybe", "ИСТИНА")
    assert _column(df, tokens.to_bool(F.col("t"))) == [True, False, True, None, None]
    assert _column(df, tokens.to_bool(F.col("t"), tokens.XML)) == [True, False, True, None, True]
    assert _column(df, tokens.to_bool(F.col("t"), tokens.MAPPING)) == [False, False, True, False, False]


def test_numbers(spark):
    df = _texts(spark, "1 234,56", "1,234", "1,234.5", "1,234,567", "1e5", "-3.5", "9007199254740993", "-0.5")
    assert _column(df, tokens.to_double(F.col("t"))) == [1234.56, 1.234, 1234.5, None, None, -3.5, 9007199254740993.0, -0.5]
    assert _column(df, tokens.to_int(F.col("t"))) == [1234, 1, 1234, None, None, -3, 9007199254740993, 0]
    assert str(_column(_texts(spark, "12,345"), tokens.to_decimal(F.col("t"), 10, 2))[0]) == "12.35"


def test_dates_and_times(spark):
    df = _texts(spark, "03/02/2024", "12/31/2024", "03.02.2024", "bad", "2024-02-30")
    assert [None if d is None else d.isoformat() for d in _column(df, tokens.to_date(F.col("t")))] == ["2024-02-03", "2024-12-31", "2024-02-03", None, None]
    df = _texts(spark, "2025-09-22T09:30:00.500Z", "2025-09-22T09:30:00+03:00", "2025-09-22 09:30:00.1239", "nope")
    assert _column(df, F.unix_millis(tokens.to_timestamp_ms(F.col("t")))) == [1758533400500, 1758522600000, 1758533400123, None]


def test_types():
    assert types.to_pg("numeric(12, 2)") == "numeric(12,2)" and types.to_ch("lowcard_string") == "LowCardinality(String)"
    assert types.parse("decimal") == ("decimal", (18, 6)) and types.parse("whatever") == ("string", None)
    assert types.to_spark("decimal(40,2)").simpleString() == "string" and types.decimal_of(1, 3) == "decimal(3,3)"


def test_strict_types_of_mixed_columns(spark):
    df = spark.createDataFrame([("1", "1.5", "x", "1e5", None), ("2", "2", "3", "2e4", " ")], "a string, b string, c string, d string, e string")
    got = {r.column: r.type for r in infer.strict_types(df).collect()}
    assert got == {"a": "int32", "b": "float64", "c": "string", "d": "float64", "e": "string"}


def test_csv_to_routes(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(ORDERS)
    raw = delimited.read(spark, f"file://{tmp_path}/orders.csv")
    mapping = routing.Mapping.from_json(
        {
            "staging_table": "staging",
            "select_schema": {"order_id": "int64", "user_id": "int64", "user_email": "string", "user_name": "string", "order_ts": "timestamp", "amount": "decimal(12,2)"},
            "route": [
                {"into": "users", "select": {"user_id": "user_id", "email": "user_email"}, "upsert_key": ["user_id"]},
                {"into": "orders", "when": "amount IS NOT NULL", "select": {"order_id": "order_id", "user_id": "user_id", "amount": "amount"}, "upsert_key": ["order_id"]},
            ],
        }
    )
    tables = {"users": {"user_id": "int64", "email": "string"}, "orders": {"order_id": "int64", "user_id": "int64", "amount": "decimal(12,2)"}}
    assert routing.lint(mapping, tables) == []
    assert routing.lint(mapping, {"users": {"user_id": "int64"}}) == ["users: no column email", "orders: no such table"]
    good, dead = routing.run(mapping, routing.staging(raw, mapping.select_schema))
    assert good["users"].count() == 2 and good["orders"].count() == 3 and dead.isEmpty()
    assert quality.orphans(good["orders"], good["users"], {"user_id": "user_id"}).isEmpty()
    quality.assert_loaded(good["orders"], ["order_id"])
    with pytest.raises(AssertionError):
        quality.assert_loaded(raw, ["user_id"])


def test_latest_stock_by_ordinal(spark, tmp_path):
    (tmp_path / "stock.csv").write_text(STOCK)
    raw = delimited.read(spark, f"file://{tmp_path}/stock.csv").withColumn("ord", F.monotonically_increasing_id())
    staged = routing.staging(raw.drop("ord"), {"sku": "string", "warehouse_id": "int32", "qty": "int32"}, load_ts=F.lit("2025-01-01").cast("timestamp"))
    staged = staged.withColumn("ord", F.monotonically_increasing_id())
    route = routing.Route("inventory", {"sku": "sku", "warehouse_id": "warehouse_id", "qty": "qty"}, "1", ("sku", "warehouse_id"))
    got = {(r.sku, r.warehouse_id): r.qty for r in routing.route(staged, route, ("load_ts", "ord")).collect()}
    assert got == {("P100", 101): 155, ("P200", 101): 7, ("P200", 102): None}
    route = routing.Route("t", {"sku": "sku", "qty": "qty"}, "", ("sku",), "column")
    assert {r.sku: r.qty for r in routing.route(staged, route, ("load_ts", "ord")).collect()} == {"P100": 155, "P200": 7}


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (None, 999.0)], "id int, amount double")
    good, bad = quality.split(df, {"amount": (0, 100)}, ["id"])
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert {tuple(r.failed) for r in bad.collect()} == {("amount out of range",), ("id is null", "amount out of range")}


def test_upserts(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 5, "n")], "k int, ts int, v string")
    new = spark.createDataFrame([(2, 10, "B"), (1, 11, None), (3, 1, "c"), (None, 9, "m")], "k int, ts int, v string")
    assert sorted(map(tuple, routing.upsert(old, new, ["k"]).collect()), key=str) == sorted([(None, 5, "n"), *map(tuple, new.collect())], key=str)
    got = routing.upsert_newer(old, new, ["k"], "ts", keep=("v",)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 11, "a"), (2, 20, "b"), (3, 1, "c"), (None, 5, "n"), (None, 9, "m")], key=str)


NESTED = """[{"id":1,"name":"a","addr":{"city":"X","geo":{"lat":1.5}},"tags":["p","q"],
  "items":[{"sku":"s1","qty":2,"opts":[{"k":"c"}]},{"sku":"s2","qty":3000000000}]},
 {"id":2,"name":null,"addr":{},"tags":[],"seen":"2025-01-02T03:04:05.678Z"}]"""


def test_nested_json(spark, tmp_path):
    (tmp_path / "n.json").write_text(NESTED)
    found = {e.name: e for e in nested.entities(documents.json_records(spark, f"file://{tmp_path}/n.json"), "rec_id")}
    assert set(found) == {"__root__", "__root____tags", "__root____items", "__root____items__opts"}
    root = {r.rec_id: r for r in found["__root__"].rows.collect()}
    assert root[1].addr__geo__lat == 1.5 and root[1].addr__city == "X" and root[2].addr__city is None
    assert sorted(map(tuple, found["__root____tags"].rows.collect())) == [(1, 1, "p"), (1, 2, "q")]
    assert sorted((r.rec_id, r.idx1, r.sku, r.qty) for r in found["__root____items"].rows.collect()) == [(1, 1, "s1", 2), (1, 2, "s2", 3000000000)]
    assert [tuple(r) for r in found["__root____items__opts"].rows.collect()] == [(1, 1, 1, "c")]
    assert found["__root____items__opts"].parent == "__root____items" and found["__root____items"].keys == ("rec_id", "idx1")


def test_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<root><item><code>1</code><p><q>a</q></p><c><n>1</n></c><c><n>2</n></c></item><item><code>2</code></item></root>")
    records = documents.xml_records(spark, f"file://{tmp_path}/x.xml", "item", "code int, p struct<q:string>, c array<struct<n:int>>")
    wrapped = records.select(F.col("code").cast("long").alias("rec_id"), F.struct("*").alias("record"))
    found = {e.name: e.rows.collect() for e in nested.entities(wrapped, "rec_id", name="item")}
    assert sorted((r.code, r.p__q) for r in found["item"]) == [(1, "a"), (2, None)] and [tuple(r) for r in found["item__c"]] == [(1, 1, 1), (1, 2, 2)]
    keyed = {e.name: e.rows for e in nested.surrogates(nested.entities(wrapped, "rec_id", name="item"))}
    assert sorted((r.id, r.code, r.p__q) for r in keyed["item"].collect()) == [(1, 1, "a"), (2, 2, None)]
    assert sorted((r.id, r.item_id, r.seq, r.n) for r in keyed["item__c"].collect()) == [(1, 1, 1, 1), (2, 1, 2, 2)]
    edges = [r.asDict() for r in nested.edges(wrapped).collect()]
    assert {(e["child"], e["min_children"], e["max_children"], e["is_list"]) for e in edges} == {("code", 1, 1, False), ("p", 0, 1, False), ("q", 1, 1, False), ("c", 0, 2, True), ("n", 1, 1, False)}
    assert model.entity_fields(edges, "/root/item") == {"/root/item": {"parent": None, "fields": {"code": {"optional": False}, "p/q": {"optional": True}}}, "/root/item/c": {"parent": "/root/item", "fields": {"n": {"optional": False}}}}


def test_json_tools(spark, tmp_path):
    dirty = 'noise {"a":1, // one\n "b":[2,3,], /* two */ "c":{"d":4,},} tail'
    assert documents.parse_dirty(dirty) == {"a": 1, "b": [2, 3], "c": {"d": 4}} and documents.parse_dirty("none") is None
    assert _column(_texts(spark, dirty, "x"), documents.clean_json(F.col("t"))) == ['{"a":1,"b":[2,3],"c":{"d":4}}', None]
    (tmp_path / "l.jsonl").write_text('{"a":1}\nbroken\n{"a":2}\n')
    assert documents.json_lines(spark, f"file://{tmp_path}/l.jsonl").count() == 2
    assert documents.connection("postgresql://u:p@h:5432/db") == {"scheme": "postgresql", "user": "u", "password": "p", "host": "h", "port": 5432, "name": "db"}
    kinds = _column(_texts(spark, "true", "7", "3000000000", "1.5", '"2025-01-02"', '"2025-01-02T03:04:05.678Z"', '"x"', "[1]", None), infer.json_value_type(F.col("t")))
    assert kinds == ["bool", "int32", "int64", "float64", "date", "timestamp64(ms)", "string", "json", None]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("имя;сумма;;город\nОльга;1,5;x;y\n\"a\nb\";2\nc;3;4;5;6\n".encode("cp1251"))
    found = delimited.detect(spark, f"file://{tmp_path}/m.csv")
    assert (found["encoding"], found["delimiter"], found["columns"]) == ("cp1251", ";", ["имя", "сумма", "column", "город"])
    rows = delimited.read(spark, f"file://{tmp_path}/m.csv", found["columns"], ";", True, "cp1251").collect()
    assert [r[0] for r in rows] == ["Ольга", "a\nb", "c"] and rows[1][2] is None and rows[2][3] == "5"
    assert delimited.unique_headers(["x", "", "x", " x "]) == ["x", "column", "x__2", "x__3"]
    assert not delimited.looks_like_header(["1", "2", "3"]) and delimited.looks_like_header(["a", "b", "1"])
    df = spark.createDataFrame([("1", "да"), (None, "2024-01-01")], "b string, a string")
    delimited.export(df, f"file://{tmp_path}/out", ["a", "b", "z"])
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()) == [("2024-01-01", None, None), ("да", "1", None)]
    delimited.to_parquet(df, {"b": "int32", "z": "date"}, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p").dtypes == [("b", "int"), ("z", "date")]
    assert set(delimited.codec_sizes(df, f"file://{tmp_path}/codecs")) == {"zstd", "snappy", "gzip"}


def test_models():
    m = {
        "main_entity": {"name": "Ticket Fact", "keys": ["ticket_number"], "columns": ["ticket_number", "museum_inn"]},
        "entities": [{"name": "Client", "keys": ["client_phone"], "columns": ["client_phone", "museum_inn"]}, {"name": "Museum", "keys": ["museum_inn"], "columns": ["museum_inn", "museum_name"]}],
        "under_question_columns": ["order_number", "status"],
    }
    after = model.rebalance(m, {"client_phone": 100_000, "order_number": 400_000, "museum_name": 9}, 478_563)
    assert after["main_entity"]["columns"] == ["ticket_number", "museum_inn", "client_phone", "order_number"] and after["main_entity"]["keys"] == ["ticket_number", "client_phone"]
    assert after["entities"] == [{"name": "Museum", "keys": [], "columns": ["museum_name"]}] and after["under_question_columns"] == ["status"]
    assert model.coverage(m, after) == {"missing": [], "added": []}
    assert model.grain([{"columns": ["a"], "keys": []}, {"columns": ["b", "c"], "keys": ["b"]}, {"columns": ["d", "e"], "keys": ["d"]}])["columns"] == ["b", "c"]
    taken = set()
    assert [model.identifier(n, taken) for n in ("Order ID", "order-id", "orderId", "Имя")] == ["order_id", "order_id_2", "order_id_3", "имя"]
    assert model.load_order({"c": {"b"}, "b": {"a"}, "a": set(), "x": {"y"}, "y": {"x"}}) == ["a", "b", "c", "x", "y"]
    tables = {"users": {"columns": ["id"], "primary_key": ["id"]}, "orders": {"columns": ["id", "user_id"], "primary_key": ["id"]}}
    assert model.guess_foreign_keys(tables) == [("orders", "user_id", "users", "id")]
    assert model.patch_errors({"version": 1, "entities": [{"path": "/a", "alias": "ok", "fields": [{"name": "x", "alias": "Bad"}]}]}, {"/a": ["x"]}) == ["bad alias 'Bad' at /a::x"]
    assert model.schema_differences({"a": "int32", "b": "string"}, {"a": "int64", "c": "string"}) == {"missing": ["b"], "unexpected": ["c"], "types": ["a"]}


def test_rename_keeps_comments(spark):
    df = model.rename(spark.range(1), {"id": "number"}, {"id": "a count"})
    assert df.columns == ["number"] and df.schema["number"].metadata["comment"] == "a count"


def test_ddl(spark):
    users = ddl.Table("users", (ddl.Column("id", "int64", False), ddl.Column("name", "lowcard_string", comment="full")), ("id",))
    orders = ddl.Table("orders", (ddl.Column("id", "int64", False), ddl.Column("user_id", "int64", False), ddl.Column("amount", "decimal(12,2)", low=0), ddl.Column("at", "timestamp64(ms)")), ("id",), ((("user_id",), "users", ("id",)),))
    pg = ddl.postgres(orders)
    assert '"amount" numeric(12,2)' in pg and "CHECK (\"amount\" >= 0)" in pg and 'FOREIGN KEY ("user_id") REFERENCES "users" ("id")' in pg
    ch = ddl.clickhouse(orders)
    assert "`at` Nullable(DateTime64(3,'UTC'))" in ch and ch.endswith("ORDER BY (`id`);") and "LowCardinality(Nullable(String))" in ddl.clickhouse(users)
    text = ddl.dbml([users, orders])
    assert 'Ref: "orders".user_id > "users".id' in text and "id int64 [pk, not null]" in text.replace('"', "")
    back = {t.name: t for t in ddl.parse_ddl(pg + ddl.clickhouse(users))}
    assert [c.name for c in back["orders"].columns] == ["id", "user_id", "amount", "at"] and back["orders"].foreign_keys == orders.foreign_keys and back["users"].columns[1].type == "String"
    assert ddl.choose_order_by(users.columns) == ("id",) and ddl.widened(orders).columns[2].type == "decimal(28,2)"
    spark.sql("CREATE DATABASE IF NOT EXISTS loam_test")
    documents.run_statements(spark, ddl.spark(orders, "loam_test"))
    assert documents.table_facts(spark, "loam_test.orders") == {"columns": {"id": "int64", "user_id": "int64", "amount": "decimal(12,2)", "at": "timestamp"}, "rows": 0}
    spark.sql("DROP DATABASE loam_test CASCADE")


def test_profiles_of_awkward_columns(spark):
    df = spark.createDataFrame([(1, None, " a"), (2, None, "b"), (3, None, None)], "`x.y` int, n string, s string")
    got = {r.column: (r.n_null, r.n_distinct, r.uniqueness) for r in profile.counts(df).collect()}
    assert got == {"x.y": (0, 3, 1.0), "n": (3, 0, 0.0), "s": (1, 2, 0.666667)}
    flags = {r.column: (r.constant, r.mostly_null, r.has_edge_spaces) for r in profile.anomalies(df).collect()}
    assert flags == {"x.y": (False, False, False), "n": (False, True, False), "s": (False, False, True)}
    assert {r.column: r.is_sorted for r in profile.sorted_columns(df, "x.y", ["x.y", "s"]).collect()} == {"x.y": True, "s": False}
    scale = profile.scales(spark.createDataFrame([("0,5",), ("12.125",), ("-3",)], "v string"), ["v"]).first()
    assert (scale["whole_digits"], scale["scale"], scale["scales"]) == (2, 3, [0, 1, 3])


def test_streaming_routes(spark, tmp_path):
    from loamwork.streaming import ingest

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "v": 10 * k + i, "ts": f"2025-01-01T0{k}:00:00Z"}) for i in range(3)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in order of time
    stream = spark.readStream.schema("id long, v long, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    mapping = routing.Mapping("s", {"id": "int64"}, (routing.Route("t", {"id": "id", "v": "v"}, "v >= 1", ("id",)),), {"t": {"v": (0, 21)}})
    ingest.into_routes(stream, mapping, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ("ts",)).trigger(availableNow=True).start().awaitTermination()
    landed = spark.read.parquet(f"file://{tmp_path}/out/t")
    assert landed.count() == 7 and {r.id: r.v for r in ingest.current(landed, ["id"]).collect()} == {0: 20, 1: 21, 2: 12}
    assert spark.read.parquet(f"file://{tmp_path}/out/__dead").count() == 1
    once = ingest.once(stream, ["id"], "ts", "10 hours").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 3


def test_scratch_tables(spark):
    df = scratch.materialise(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("x", "string")]
    gone = scratch.materialise(df, "gone")
    scratch.release(gone)
    with pytest.raises(Exception, match="gone-"):
        gone.collect()
    small = scratch.broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in small and "ResolvedHint" not in scratch.broadcast_if_small(df, 9)._jdf.queryExecution().analyzed().toString()


def test_table_lifecycle(spark, tmp_path):
    users = ddl.Table("users", (ddl.Column("id", "int64", False), ddl.Column("name", "string")), ("id",))
    orders = ddl.Table("orders", (ddl.Column("id", "int64", False), ddl.Column("user_id", "int64"), ddl.Column("seq", "int32")), ("id",), ((("user_id",), "users", ("id",)),))
    assert [t.name for t in tables.order([orders, users])] == ["users", "orders"]
    tables.ensure_database(spark, "loam_life")
    tables.recreate(spark, [orders, users], "loam_life")
    assert tables.load(spark.range(5).withColumn("extra", F.lit(1)), "users", "loam_life") == 5
    assert routing.row_counts({t: spark.table(f"loam_life.{t}") for t in ("users", "orders")}).orderBy("name").collect() == [("orders", 0), ("users", 5)]
    assert tables.preview(spark.table("loam_life.users").orderBy("id"), 1) == "id,name\n0,\n"
    tables.truncate(spark, [orders, users], "loam_life")
    assert spark.table("loam_life.users").isEmpty()
    tables.drop_database(spark, "loam_life")
    (tmp_path / "a.json").write_text('{"a":\n1}')
    assert [r.payload for r in tables.registry(spark, f"file://{tmp_path}").collect()] == ['{"a":\n1}']
    assert tables.unique_keys(orders, ["id", "nope"], "seq") == (("id",), ("user_id", "seq"))


def test_json_patch():
    cols = {"": ["id"], "items": ["sku", "qty"]}
    assert model.apply_json_patch(cols, {"[items]": "order_items", "[items]::[sku]": "article"}) == {"": ("root", {"id": "id"}), "items": ("order_items", {"sku": "article", "qty": "qty"})}
    assert model.json_patch_errors({"[x]": "a", "[items]::[z]": "b", "[items]": "Bad", "oops": "c"}, cols) == ["unknown key [x]", "unknown column [items]::[z]", "bad name 'Bad' for [items]", "unknown key oops"]


def test_upsert_keeps_what_the_source_lacks(spark):
    old = spark.createDataFrame([(1, "a", "keepme"), (2, "b", "too")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "new"), (3, "c")], "k int, v string")
    assert sorted(map(tuple, routing.upsert(old, new, ["k"]).collect())) == [(1, "new", "keepme"), (2, "b", "too"), (3, "c", None)]


def test_late_batches_stay_older(spark, tmp_path):
    """A later batch with an older row, and columns taken one by one over batches."""
    from loamwork.streaming import ingest

    (tmp_path / "in").mkdir()
    batches = [[(1, "x", None, 5), (2, "p", "q", 9)], [(1, None, "y", 7), (2, "old", None, 3)]]
    for k, rows in enumerate(batches):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "a": a, "b": b, "ts": f"2025-01-01T0{t}:00:00Z"}) for i, a, b, t in rows))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("id long, a string, b string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    take = {"id": "id", "a": "a", "b": "b"}
    mapping = routing.Mapping("s", {"id": "int64"}, (routing.Route("rows", take, "1", ("id",)), routing.Route("columns", take, "1", ("id",), "column")))
    ingest.into_routes(stream, mapping, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ("ts",)).trigger(availableNow=True).start().awaitTermination()
    got = {d: sorted(map(tuple, ingest.current(spark.read.parquet(f"file://{tmp_path}/out/{d}"), ["id"], d.rstrip("s")).collect())) for d in ("rows", "columns")}
    assert got == {"rows": [(1, None, "y"), (2, "p", "q")], "columns": [(1, "x", "y"), (2, "p", "q")]}


def test_times_that_are_none_and_empty_tables(spark):
    df = spark.createDataFrame([("2024/02/03 10:00:00",), ("03.02.2024 10:00:00.5",), ("never",)], "t string")
    assert tuple(profile.times(df, ["t"]).first()) == ("t", 1706954400, 1706954400)
    assert [tuple(r) for r in profile.counts(df.limit(0)).collect()] == [("t", 0, 0, 0, 0.0, 0.0)]
    assert {r.column: r.type for r in infer.xml_types(df.limit(0)).collect()} == {"t": "string"}
    assert sorted(r.i for r in profile.seeded_sample(spark.range(100).withColumnRenamed("id", "i").repartition(3), 5, "i").collect()) == sorted(r.i for r in profile.seeded_sample(spark.range(100).withColumnRenamed("id", "i"), 5, "i").collect())


def test_xml_types(spark):
    df = spark.createDataFrame([("true", "1.5", "2024-01-01", "123456789", "1e5", "2024-01-01T10:00:00.123Z", "12"), ("False", "22,25", "2024-01-02", "-7", "2E3", "2024-01-01T10:00:00.1", "x")], "a string, b string, c string, d string, e string, f string, g string")
    assert {r.column: r.type for r in infer.xml_types(df).collect()} == {"a": "bool", "b": "decimal(4,2)", "c": "date", "d": "int32", "e": "float64", "f": "timestamp64(ms)", "g": "string"}


def test_json_names_that_look_like_types(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"x":{"y":[{"VOID_FLAG":1,"OBJECT":{"VOID":null}},{"VOID_FLAG":2}]}}')
    got = documents.json_records(spark, f"file://{tmp_path}/v.json", record_path="x.y")
    assert got.schema["record"].dataType.simpleString() == "struct<OBJECT:struct<VOID:string>,VOID_FLAG:bigint>"
    assert [r.record.VOID_FLAG for r in got.orderBy("rec_id").collect()] == [1, 2]


def test_xml_rows_and_nearest_text(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<root><item k="1"><b><c>5</c></b><a q="z">t1</a><a>t2</a></item><item><a>t3</a></item></root>')
    items = documents.xml_records(spark, f"file://{tmp_path}/x.xml", "item", "_k string, b struct<c:string>, a array<struct<_q:string,_value:string>>")
    assert sorted(map(tuple, documents.xml_rows(items).collect())) == [("", "", "", "t3"), ("1", "5", "z", "t1 | t2")]
    assert len(documents.xml_rows(items, explode=True).collect()) == 3
    records = items.select(F.struct("b", "a").alias("record"))
    kind = records.schema["record"].dataType
    got = records.select(nested.first_text(F.col("record"), kind, ["a"]).alias("a"), nested.first_text(F.col("record"), kind, ["b", "c"]).alias("c"), nested.first_text(F.col("record"), kind, ["no"]).alias("no")).collect()
    assert sorted(map(tuple, got), key=str) == [("t1", "5", None), ("t3", None, None)]
    both = spark.sql("SELECT named_struct('deep', named_struct('x', 'far'), 'flat', 'near') AS v")
    assert both.select(nested.first_text(F.col("v"), both.schema["v"].dataType)).first()[0] == "near"


def test_files_are_split_unless_cells_have_line_breaks(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        plain = delimited.read(spark, f"file://{tmp_path}/plain.csv")
        assert plain.rdd.getNumPartitions() > 1 and plain.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in delimited.read(spark, f"file://{tmp_path}/broken.csv").collect()] == [("1", "x\ny")]
    assert delimited.count_lines(spark, f"file://{tmp_path}/broken.csv") == 2 and delimited.count_records(spark, f"file://{tmp_path}/broken.csv") == 1
    typed = delimited.read_typed(spark, f"file://{tmp_path}/plain.csv", 100)
    assert typed.dtypes == [("a", "int"), ("b", "string")] and delimited.sample(spark, f"file://{tmp_path}/plain.csv", 7).count() == 7
    assert delimited.detect_delimiter(["a:b:c", "d:e:f,g"], by_median=True) == ":"
    assert set(delimited.codec_sizes(typed, f"file://{tmp_path}/sizes", ("zstd", "brotli"), "a", 1000)) == {"zstd", "brotli"} and delimited.best_codec({"b": 2, "a": 2, "c": 3}) == "a"
    tables.write_sorted(typed.withColumn("p", F.col("a") % 3), f"file://{tmp_path}/laid", ["a"], ["p"])
    assert spark.read.parquet(f"file://{tmp_path}/laid").groupBy("p").count().count() == 3
    tables.write_text(spark, f"file://{tmp_path}/note.md", "é")
    assert (tmp_path / "note.md").read_text() == "é"


def test_schema_documents():
    doc = {
        "database": "dw",
        "tables": [
            {"name": "u", "columns": [{"name": "id", "type": "int64", "nullable": False}, {"name": "n", "type": "string", "default": "'x'"}], "primary_key": ["id"], "ordering": {"by": ["id"]}, "partitioning": {"by": "to_date(at)"}, "quality_expectations": {"ranges": {"id": [0, None]}}},
            {"name": "o", "columns": [{"name": "uid", "type": "int64"}], "foreign_keys": [{"columns": ["uid"], "ref_table": "u", "ref_columns": ["id"]}]},
        ],
    }
    u, o = documents.schema_document(doc)
    pg = ddl.postgres(u, checks_later=True)
    assert "DEFAULT 'x'" in pg and 'ADD CONSTRAINT "u_id_range" CHECK ("id" >= 0) NOT VALID;' in pg and 'REFERENCES "u" ("id")' in ddl.postgres(o)
    made = ddl.document_clickhouse([u, o], "dw")
    assert made[0] == "CREATE DATABASE IF NOT EXISTS `dw`;" and "PARTITION BY toYYYYMM(at)" in made[1] and "ORDER BY (`uid`)" in made[2] and "Nullable" not in made[2]
    assert "ordered by id; partitioned by to_date(at); id in [0, ]" in ddl.document_dbml([u, o], {"stg": {"a": "int32"}})
    assert '"load_ts" timestamptz DEFAULT now()' in ddl.staging("stg", {"a": "int32"}, "postgres") and "`a` Nullable(Int32)" in ddl.staging("stg", {"a": "int32"}, "clickhouse", "dw")
    assert "ENGINE" not in ddl.without_engine(made[1]) and [c.name for c in ddl.parse_ddl(ddl.without_engine(made[1]))[0].columns] == ["id", "n"]
    back = ddl.parse_ddl("create table t (id int primary key, u_id int not null references users(id), x text)")[0]
    assert back.primary_key == ("id",) and back.foreign_keys == ((("u_id",), "users", ("id",)),) and [c.type for c in back.columns] == ["int", "int", "text"]
    assert "`rec_id` UInt64" in ddl.clickhouse(ddl.Table("t", (ddl.Column("rec_id", "int64"),), ("rec_id",)), unsigned_keys=True)
    assert model.table_differences(u, o) == {"missing": ["id", "n"], "unexpected": ["uid"], "primary_key": [["id"], []], "order_by": [["id"], []]}
    assert model.model_differences([u, o], [u]) == {"missing": ["o"], "undeclared": [], "changed": {}}


def test_entity_hints_and_profile_patches():
    edges = [{"parent": "/r", "child": c, "min_children": n, "max_children": m, "is_list": m > 1} for c, n, m in (("box", 0, 1), ("code", 1, 1))] + [{"parent": "/r/box", "child": "x", "min_children": 1, "max_children": 4, "is_list": True}]
    assert model.child_map(edges, "/r") == {"/r/box/x": {"via": "box/x", "min": 0, "max": 4}}
    assert model.key_hints(["a/code", "id", "name", "deep/er/id"]) == ["id", "deep/er/id", "a/code"] and model.order_hints(["a/seq", "name", "row_index"]) == ["a/seq", "row_index"]
    profile_ = {
        "entities": [{"path": [], "name": "root", "parent": None, "columns": [{"path": ["id"], "name": "id"}]}, {"path": ["items"], "name": "items", "parent": "root", "columns": [{"path": ["sku"], "name": "sku"}, {"path": ["q"], "name": "q"}]}],
        "relations": [{"parent": "root", "child": "items", "parent_columns": ["rec_id"], "child_columns": ["rec_id"]}],
    }
    bad = {"entity_names": {"[]": "items", "oops": "x", '["no"]': "y"}, "column_names": {'["items"]::["sku"]': "rec_id", '["items"]::["z"]': "a", '["items"]::["q"]': "sku"}, "entity_descriptions": [], "column_descriptions": {'[]::["id"]': " "}, "more": 1}
    kinds = [k for k, _ in model.profile_patch_errors(profile_, bad)]
    assert kinds == ["unknown part", "entity_names: taken", "entity_names: key", "entity_names: no such entity", "column_names: reserved", "column_names: no such column", "column_names: taken", "entity_descriptions: not an object", "column_descriptions: bad value"]
    assert model.patch_summary([]) == "SUCCESS" and model.patch_summary([("a", "x"), ("a", "y")]) == "ERROR: 2 | a (2): x, y"
    after = model.apply_profile_patch(profile_, {"entity_names": {"[]": "orders"}, "column_names": {'["items"]::["sku"]': "article"}, "entity_descriptions": {"[]": "all orders"}})
    assert after["entities"][1]["parent"] == "orders" and after["relations"][0]["parent"] == "orders" and after["entities"][0]["description"] == "all orders" and after["entities"][1]["columns"][0]["name"] == "article"
    question = {"main_entity": {"name": "F", "keys": [], "columns": ["a"]}, "entities": [{"name": "E", "keys": [], "columns": ["b"]}], "under_question_columns": [{"column": "c", "why": "?"}, {"column": "d"}]}
    rebalanced = model.rebalance(question, {"c": 90}, 100)
    assert rebalanced["main_entity"]["columns"] == ["a", "c"] and rebalanced["under_question_columns"] == [{"column": "d"}] and model.coverage(question, rebalanced) == {"missing": [], "added": []}
    assert model.grain_report([{"name": "E", "keys": ["b"], "columns": ["b", "c"]}]) == "grain: E (b)\nE: keys b; columns b, c"


def test_low_cardinality_is_decided_by_exact_counts(spark):
    from loamwork.operators import infer

    df = spark.range(5010).selectExpr(*[f"concat('{c}', id % 500) AS {c}500" for c in "pqrstuvw"], *[f"concat('{c}', id % 501) AS {c}501" for c in "pqrstuvw"])
    got = {r["column"]: r["type"] for r in infer.threshold_types(df, lowcard_max=500).collect()}
    assert got == {c: "lowcard_string" if c.endswith("500") else "string" for c in df.columns}
