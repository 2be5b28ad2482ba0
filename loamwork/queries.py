"""The registered queries of the core library, each over its whole tables, and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions import tokens
from loamwork.operators import bounded, infer, nested, preprocess, profile, quality, routing
from loamwork.plans import ddl
from loamwork.plans.scratch import scratch_root
from loamwork.sources import bucketed, cycle, database, delimited, documents, xml_events
from loamwork.streaming import keyed

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, times without a zone read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in df.dtypes])


def _each(columns: list[str], sql: str) -> str:
    """One SELECT for each column, ``{c}`` being its name."""
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


# --- routing -----------------------------------------------------------------------------------------

_CLICK = routing.Route("clicks", {"user_id": "user_id", "event_id": "event_id", "event_type": "event_type", "value": "value"}, "event_type = 'click'", ("user_id",))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a staging table, routed to each user's newest click."""
    staged = table(spark, sf_dir, "events").withColumn("load_ts", F.col("ts"))
    return routing.route(staged, _CLICK, ("load_ts", "event_id"))


@_query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type = 'click') WHERE rn = 1")
def route_dedup_row(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query("SELECT event_id, upper(event_type) AS kind, value * 2 AS doubled FROM events WHERE value > 10")
def route_append_filter(spark, sf_dir):
    r = routing.Route("t", {"event_id": "event_id", "kind": "upper(event_type)", "doubled": "value * 2"}, "value > 10")
    return routing.route(table(spark, sf_dir, "events").withColumn("load_ts", F.col("ts")), r)


@_query("""SELECT user_id, max_by(k, (ts, event_id)) FILTER (k IS NOT NULL) AS kind, max_by(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value
FROM (SELECT *, nullif(event_type, 'view') AS k FROM events) GROUP BY user_id""")
def route_dedup_column(spark, sf_dir):
    r = routing.Route("t", {"user_id": "user_id", "kind": "nullif(event_type, 'view')", "value": "value"}, "1", ("user_id",), "column")
    return routing.route(table(spark, sf_dir, "events"), r, ("ts", "event_id"))


_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


@_query(f"""WITH n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'N' AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)
SELECT {_ORDER} FROM orders o WHERE o_orderkey % 2 = 0 AND NOT EXISTS (FROM n WHERE n.o_orderkey = o.o_orderkey) UNION ALL SELECT {_ORDER} FROM n""")
def route_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(*_ORDER.split(", "))
    source = o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1).withColumn("o_orderstatus", F.lit("N"))
    return routing.upsert(o.where("o_orderkey % 2 = 0"), source, ["o_orderkey"])


@_query("""WITH t AS (SELECT user_id, max(event_id) AS at, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
s AS (SELECT user_id, max(event_id) AS at, min(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT coalesce(t.user_id, s.user_id) AS user_id, CASE WHEN s.user_id IS NOT NULL AND (t.user_id IS NULL OR s.at > t.at) THEN s.at ELSE t.at END AS at,
CASE WHEN s.user_id IS NOT NULL AND (t.user_id IS NULL OR s.at > t.at) THEN s.value ELSE t.value END AS value FROM t FULL JOIN s ON t.user_id = s.user_id""")
def upsert_time_guarded(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("at"), F.max("value").alias("value"))
    new = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("at"), F.min("value").alias("value"))
    return routing.upsert_newer(old, new, ["user_id"], "at")


@_query("SELECT event_type AS name, count(*) AS n_rows FROM events GROUP BY 1")
def route_fanout_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = [r[0] for r in e.select("event_type").distinct().limit(101).collect()]
    if len(kinds) > 100:  # routes are declared one by one: no kind goes without one unseen
        raise ValueError("over 100 event types need a mapping of their own")
    routes = tuple(routing.Route(k, {"event_id": "event_id"}, f"event_type = '{k}'") for k in kinds)
    good, _ = routing.run(routing.Mapping("staging", {"event_id": "int64"}, routes), e.withColumn("load_ts", F.col("ts")))
    return routing.row_counts(good)


@_query("SELECT event_id, props FROM events ORDER BY event_id DESC LIMIT 1")
def raw_latest_record(spark, sf_dir):
    return documents.latest(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")


@_query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT l_partkey + 100000000, min(l_suppkey) FROM lineitem WHERE l_partkey + 100000000 NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def route_insert_missing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    more = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 100000000).alias("o_orderkey")).agg(F.min("l_suppkey").alias("o_custkey"))
    return routing.insert_missing(o, more, ["o_orderkey"])


@_query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def route_upsert_partial(spark, sf_dir):
    """The source lacks a column of the target: it stays where the key was there, and is null in new rows."""
    o = table(spark, sf_dir, "orders").select(*_ORDER.split(", "))
    source = o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", F.lit("N").alias("o_orderstatus"))
    return routing.upsert(o.where("o_orderkey % 2 = 0"), source, ["o_orderkey"])


@_query("""WITH t AS (SELECT user_id, max(event_id) AS at, max(value) AS value, min(event_type) AS kind FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
s AS (SELECT user_id, max(event_id) AS at, CASE WHEN user_id % 2 = 0 THEN min(value) END AS value FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
j AS (SELECT coalesce(t.user_id, s.user_id) AS user_id, t.at AS old, s.at AS new, t.value AS v, s.value AS w, t.kind, s.user_id IS NOT NULL AND (t.user_id IS NULL OR s.at > t.at) AS wins FROM t FULL JOIN s ON t.user_id = s.user_id)
SELECT user_id, CASE WHEN wins THEN new ELSE old END AS at, CASE WHEN wins THEN coalesce(w, v) ELSE v END AS value, kind FROM j""")
def upsert_newer_partial(spark, sf_dir):
    """Only newer rows win; the source lacks a column of the target, and its nulls in another don't count."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("at"), F.max("value").alias("value"), F.min("event_type").alias("kind"))
    new = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("at"), F.when(F.col("user_id") % 2 == 0, F.min("value")).alias("value"))
    return routing.upsert_newer(old, new, ["user_id"], "at", keep=("value",))


@_query(f"""WITH n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 9 = 0)
SELECT {_ORDER} FROM orders o WHERE o_orderkey % 2 = 0 AND NOT EXISTS (FROM n WHERE n.o_orderkey = o.o_orderkey)
UNION ALL SELECT n.*, o.o_orderpriority FROM n LEFT JOIN (FROM orders WHERE o_orderkey % 2 = 0) o ON o.o_orderkey = n.o_orderkey""")
def upsert_at_rest(spark, sf_dir):
    """A stored table whose touched buckets are rewritten, by two upserts that each bring half of the keys."""
    o, path = table(spark, sf_dir, "orders").select(*_ORDER.split(", ")), _folder(spark, "bucketed")
    bucketed.create(o.where("o_orderkey % 2 = 0"), path, ["o_orderkey"], 8)
    source = o.where("o_orderkey % 9 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("N").alias("o_orderstatus"))
    for part in (0, 1):
        bucketed.upsert(spark, path, source.where(F.col("o_orderkey") % 2 == part))
    return bucketed.read(spark, path)


@_query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events WHERE event_type = 'click') WHERE rn = 1")
def stream_newest_row(spark, sf_dir):
    """Events as a stream in several batches, out of order, into a table of each user's newest click: the batch route's result."""
    path = _folder(spark, "stream")
    e = table(spark, sf_dir, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)))
    e.repartition(3, "part").drop("part").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    changes = keyed.routed(stream, _CLICK, ("ts", "event_id"), "ts", delay="3650 days", keep_ms=1 << 42)
    keyed.into_table(changes, f"{path}/out", f"{path}/checkpoint", ["user_id"], 8).trigger(availableNow=True).start().awaitTermination()
    return bucketed.read(spark, f"{path}/out")


# --- casts -------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment = 'BUILDING' AS building FROM customer")
def staging_typed_load(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(*[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_nationkey")], F.when(F.col("c_mktsegment") == "BUILDING", " Да ").otherwise("нет").alias("building"))
    return routing.staging(raw, {"c_custkey": "int64", "c_name": "string", "c_nationkey": "int32", "building": "bool"}).drop("src_file", "load_ts")


@_query("SELECT doc_id, CASE WHEN lang = 'en' OR doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents")
def null_token_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tokens.cleaned(F.when(F.col("lang") == "en", " N/A ").when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang"))).alias("lang"))


@_query("SELECT doc_id, quality = 1 AS good, CASE WHEN toxic = 1 THEN 'true' END AS bad FROM labels")
def bool_normalise(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", tokens.to_bool(F.col("quality").cast("string")).alias("good"), tokens.to_bool(F.when(F.col("toxic") == 1, "YES").otherwise("perhaps")).cast("string").alias("bad"))


@_query("SELECT l_orderkey, l_linenumber, ((n // 100) || '.' || lpad((n % 100)::VARCHAR, 2, '0'))::DOUBLE AS number, (n // 100)::BIGINT AS whole FROM (SELECT *, l_orderkey * 1007 + l_linenumber AS n FROM lineitem)")
def number_normalise(spark, sf_dir):
    """Points, commas, and thousands set apart by blanks or commas."""
    n = F.col("l_orderkey") * 1007 + F.col("l_linenumber")
    whole, cents = F.floor(n / 100).cast("bigint"), F.lpad((n % 100).cast("string"), 2, "0")
    grouped = F.format_number(whole, 0)
    texts = [F.concat(whole, F.lit("."), cents), F.concat(whole, F.lit(","), cents), F.concat(F.lit(" "), F.replace(grouped, F.lit(","), F.lit(" ")), F.lit(","), cents), F.concat(grouped, F.lit("."), cents)]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*texts), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("t"))
    return li.select("l_orderkey", "l_linenumber", tokens.to_double(F.col("t")).alias("number"), tokens.to_int(F.col("t")).alias("whole"))


@_query("SELECT l_orderkey, l_linenumber, (CASE WHEN n % 10 >= 5 THEN n // 10 + 1 ELSE n // 10 END)::BIGINT AS cents FROM (SELECT *, l_orderkey * 7 + l_linenumber AS n FROM lineitem)")
def decimal_half_up(spark, sf_dir):
    text = F.concat((F.col("n") / 1000).cast("bigint"), F.lit(","), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"))
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", (tokens.to_decimal(text, 20, 2) * 100).cast("bigint").alias("cents"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN o_orderdate::DATE END::VARCHAR AS day FROM orders")
def date_multi_format(spark, sf_dir):
    """Every pattern, the month first only where the day is over 12, and a day that is none."""
    d = F.col("o_orderdate")
    shown = [F.date_format(d, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")]
    shown += [F.when(F.dayofmonth(d) > 12, F.date_format(d, "MM/dd/yyyy")).otherwise(shown[2]), F.concat(shown[0], F.lit("T10:00:00Z")), F.concat(F.date_format(d, "yyyy-MM-"), F.lit("32"))]
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*shown), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("t"))
    return o.select("o_orderkey", tokens.to_date(F.col("t")).cast("string").alias("day"))


@_query("""SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 9 IN (0, 3, 5) THEN epoch_ms(date_trunc('second', ts)) + 500 ELSE epoch_ms(date_trunc('second', ts)) END::BIGINT AS ms FROM events""")
def timestamp_utc(spark, sf_dir):
    """ISO with and without an offset, local patterns with and without fractions, epochs, and what is no time."""
    t = F.date_trunc("second", "ts")
    show = lambda f, end="": F.concat(F.date_format(t, f), F.lit(end))
    abroad = F.concat(F.date_format(t + F.expr("INTERVAL '3' HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))
    shown = [show("yyyy-MM-dd'T'HH:mm:ss", ".500Z"), abroad, show("yyyy-MM-dd HH:mm:ss"), show("dd.MM.yyyy HH:mm:ss", ".5"), show("yyyy/MM/dd HH:mm:ss"), show("yyyy/MM/dd HH:mm:ss", ".500"), show("dd/MM/yyyy HH:mm:ss"), F.unix_timestamp(t).cast("string"), F.lit("soon")]
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*shown), (F.col("event_id") % 9 + 1).cast("int")).alias("t"))
    return e.select("event_id", F.unix_millis(tokens.epoch_or_timestamp(F.col("t"))).alias("ms"))


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source FROM documents")
def trim_blank_to_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.trimmed(F.when(F.col("doc_id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "source", F.lit(" ")))).alias("source"))


@_query("SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, NULL::VARCHAR AS note FROM orders")
def csv_to_parquet_fixed_schema(spark, sf_dir):
    """Delimited text written, read, written as Parquet of a fixed schema, and read."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    raw, out = _folder(spark, "csv"), _folder(spark, "parquet")
    o.write.option("header", True).csv(raw)
    delimited.to_parquet(delimited.read(spark, raw), {"id": "int64", "customer": "int64", "status": "string", "note": "string"}, out)
    return spark.read.parquet(out)


# --- files -------------------------------------------------------------------------------------------


#: Events that one file of json_array_splits has at most, their ids being distinct.
IDS_A_FILE = 1_000_000


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/loamwork/{name}-{uuid.uuid4().hex}"


@_query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '\"' || c_mktsegment || '\", x' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    """Delimiters, quotes and line breaks within cells; the format is detected."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", x'))).otherwise(F.col("c_name")).alias("c_name"), "c_mktsegment")
    path = _folder(spark, "csv")
    c.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return delimited.read(spark, path)


@_query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type, CASE WHEN event_id % 3 > 1 THEN user_id::VARCHAR END AS user_id FROM events")
def csv_repair(spark, sf_dir):
    """Short rows are padded, long ones cut."""
    e = table(spark, sf_dir, "events")
    cells = [F.col("event_id").cast("string"), F.concat_ws(",", "event_id", "event_type"), F.concat_ws(",", "event_id", "event_type", "user_id", F.lit("more"), F.lit("still more"))]
    path = _folder(spark, "lines")
    e.select(F.element_at(F.array(*cells), (F.col("event_id") % 3 + 1).cast("int"))).write.text(path)
    return delimited.read(spark, path, ["event_id", "event_type", "user_id"], ",", header=False)


@_query("SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_orderstatus, o_orderkey % 2 = 0 AS even FROM orders")
def csv_typed_scan(spark, sf_dir):
    """Types off a first pass over the text, values off a second."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("+"), "o_orderkey").alias("o_orderkey"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("o_orderdate"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "да").otherwise("нет").alias("even"))
    path = _folder(spark, "csv")
    o.write.option("header", True).csv(path)
    return delimited.read_typed(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@_query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS c_name, NULL::VARCHAR AS note FROM customer")
def csv_export_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("c_name"))
    path = _folder(spark, "export")
    delimited.export(c, path, ["c_custkey", "c_name", "note"])
    return delimited.read(spark, path)


def _array_file(spark, sf_dir, before: str, after: str) -> str:
    """Suppliers as one JSON array between two texts: one file, as the format has it, written record by record."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name", F.struct(F.col("s_nationkey").alias("nation")).alias("VOID"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("r"))
    first = s.agg(F.min("s_suppkey")).first()[0]
    lines = s.select("s_suppkey", F.when(F.col("s_suppkey") == first, F.col("r")).otherwise(F.concat(F.lit(", "), "r")).alias("r"))
    ends = spark.createDataFrame([(-1, before), (1 << 62, after)], "s_suppkey long, r string")
    path = _folder(spark, "json")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("s_suppkey").select("r").write.text(path)
    return path


_SUPPLIERS = "SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS rec_id, s_suppkey, s_name, s_nationkey AS \"VOID__nation\", NULL::VARCHAR AS none FROM supplier"


@_query(_SUPPLIERS)
def json_array_scan(spark, sf_dir):
    records = documents.json_records(spark, _array_file(spark, sf_dir, "[", "]"))
    return nested.entities(records, "rec_id")[0].rows.withColumn("rec_id", F.col("rec_id").cast("int"))


@_query(_SUPPLIERS)
def json_record_path(spark, sf_dir):
    records = documents.json_records(spark, _array_file(spark, sf_dir, '{"data": {"rows": [', '], "n": 1}, "other": [1, 2]}'), record_path="data.rows")
    return nested.entities(records, "rec_id")[0].rows.withColumn("rec_id", F.col("rec_id").cast("int"))


@_query("SELECT event_id AS rec_id, user_id, event_type, note FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '}, {\"[' || chr(92) || '\"' || chr(10) END AS note, row_number() OVER (ORDER BY event_id) AS n FROM events)")
def json_array_splits(spark, sf_dir):
    """A file, one line, as one array for each million of ids, read in many tasks; brackets and quotes within strings; places are kept, over all files."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", F.struct("event_type", F.array(F.lit(1), F.lit(2)).alias("more")).alias("what"), F.when(F.col("event_id") % 3 == 0, '}, {"[\\"\n').alias("note"))).alias("r"))
    low = e.agg(F.coalesce(F.min("event_id"), F.lit(0))).first()[0]
    # One task sorts and writes a file, so it has a bounded number of events, however many there are; a row a file reaches the driver.
    of = F.floor((F.col("event_id") - low) / IDS_A_FILE).alias("range")
    first = [tuple(r) for r in e.groupBy(of).agg(F.min("event_id")).sort("range").collect()]
    files = spark.createDataFrame([(k, *r) for k, r in enumerate(first)], "file int, range long, first long")
    ends = spark.createDataFrame([(k, 1 << 62, "]") for k in range(len(first))] or [(0, 0, "[]")], "file int, event_id long, r string")
    text = e.withColumn("range", of).join(F.broadcast(files), "range").select("file", "event_id", F.concat(F.when(F.col("event_id") == F.col("first"), "[").otherwise(","), "r").alias("r"))
    path = _folder(spark, "json")
    text.unionByName(ends).repartitionById(max(1, len(first)), F.col("file")).sortWithinPartitions("event_id").select("r").write.option("lineSep", " ").text(path)
    found = documents.json_array(spark, path, through=True)
    at = lambda keys, kind: tokens.json_path(F.col("value"), keys, kind)
    return found.select((F.col("rec_id") - 1 + low).alias("rec_id"), at(["user_id"], "bigint").alias("user_id"), at(["what", "event_type"], "string").alias("event_type"), at(["note"], "string").alias("note"))


@_query("SELECT doc_id::VARCHAR AS doc_id, text, source FROM documents")
def csv_multiline_split(spark, sf_dir):
    """Whole texts, line breaks and quotes included, as delimited text, read in as many tasks as lines are."""
    path = _folder(spark, "csv")
    keep = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    table(spark, sf_dir, "documents").select("doc_id", "text", "source").write.options(**keep).csv(path)
    return delimited.read(spark, path, delimiter=",")


@_query("SELECT event_id, user_id, (props->>'k')::INT AS k FROM events WHERE event_id % 10 > 0")
def json_lines_scan(spark, sf_dir):
    """Lines that are no JSON are left out."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.format_string('{"event_id": %d, "user_id": %d, "props": %s}', "event_id", "user_id", "props")))
    path = _folder(spark, "jsonl")
    e.write.text(path)
    value = F.col("value")
    return documents.json_lines(spark, path).select(tokens.json_path(value, ["event_id"], "bigint").alias("event_id"), tokens.json_path(value, ["user_id"], "bigint").alias("user_id"), tokens.json_path(value, ["props", "k"], "int").alias("k"))


def _talks_file(spark, sf_dir) -> str:
    t = _talks(spark, sf_dir).select(F.col("conv_id").alias("_id"), F.transform("record.turns", lambda x: F.struct(x["role"].alias("_role"), x["turn"].alias("nr"))).alias("turn"), F.struct(F.size("record.turns").alias("turns")).alias("size"))
    path = _folder(spark, "xml")
    t.write.format("xml").option("rowTag", "talk").option("rootTag", "talks").option("attributePrefix", "_").save(path)
    return path


def _talks_as_xml(spark, sf_dir) -> DataFrame:
    return documents.xml_records(spark, _talks_file(spark, sf_dir), "talk")


@_query("SELECT conv_id::VARCHAR AS \"@id\", string_agg(role, ' | ' ORDER BY turn, role, text) AS \"turn@role\", string_agg(turn::VARCHAR, ' | ' ORDER BY turn, role, text) AS \"turn/nr\", count(*)::VARCHAR AS \"size/turns\" FROM conversations GROUP BY conv_id")
def xml_flatten_rows(spark, sf_dir):
    return documents.xml_rows(_talks_as_xml(spark, sf_dir))


@_query("SELECT c.conv_id AS id, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, role, text)::INT AS seq, role, turn FROM conversations c")
def xml_child_rows(spark, sf_dir):
    """Elements of a list as rows, numbered within their parent."""
    records = _talks_as_xml(spark, sf_dir).select("_id", F.struct("*").alias("record"))
    rows = nested.entities(records, "_id", name="talk")[1].rows
    return rows.select(F.col("rec_id").alias("id"), F.col("idx1").alias("seq"), F.col("_role").alias("role"), F.col("nr").cast("int").alias("turn"))


@_query("SELECT '/talks/talk' AS path, 'id' AS attributes FROM conversations HAVING count(*) > 0 UNION ALL SELECT '/talks/talk/turn', 'role' FROM conversations HAVING count(role) > 0")
def xml_attributes(spark, sf_dir):
    records = _talks_as_xml(spark, sf_dir).select(F.struct("*").alias("record"))
    return nested.attributes(records, root="/talks/talk").select("path", F.array_join("attributes", ", ").alias("attributes"))


@_query("SELECT conv_id AS id, first(turn::VARCHAR ORDER BY turn, role, text) AS first FROM conversations GROUP BY conv_id")
def xml_first_text(spark, sf_dir):
    records = _talks_as_xml(spark, sf_dir).select("_id", F.struct("*").alias("record"))
    return records.select(F.col("_id").alias("id"), nested.first_text(F.col("record"), records.schema["record"].dataType, ["turn", "nr"]).alias("first"))


def _tagged_talks(spark, sf_dir) -> str:
    """Conversations as one line of XML each, with prefixes, attributes, optional and repeated elements and mixed content."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    turn = F.transform("turns", lambda x: F.concat(F.lit('<c:turn role="'), F.coalesce(x["role"], F.lit("")), F.lit('"><nr>'), x["turn"].cast("string"), F.lit("</nr>"), F.when(x["turn"] == 0, "first ").otherwise(""), F.lit("</c:turn>")))
    note = F.when(F.col("conv_id") % 3 == 0, F.lit('<note kind="a" c:lang="b"/>')).otherwise("")
    path = _folder(spark, "xml")
    t.select(F.concat(F.lit('<c:talk xmlns:c="urn:c" id="'), F.col("conv_id").cast("string"), F.lit('">'), F.array_join(turn, ""), note, F.lit("</c:talk>"))).write.text(path)
    return path


@_query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT '/talk' AS parent, 'turn' AS child, min(n) AS min_children, max(n) AS max_children, count(*) AS n_parents, max(n) > 1 AS is_list FROM c HAVING count(*) > 0
UNION ALL SELECT '/talk', 'note', CASE WHEN count(*) FILTER (conv_id % 3 = 0) < count(*) THEN 0 ELSE 1 END, 1, count(*) FILTER (conv_id % 3 = 0), false FROM c HAVING count(*) FILTER (conv_id % 3 = 0) > 0
UNION ALL SELECT '/talk/turn', 'nr', 1, 1, count(*), false FROM conversations HAVING count(*) > 0""")
def xml_graph_events(spark, sf_dir):
    """Edges of an XML structure from its events: optional children, lists, prefixes dropped."""
    return xml_events.edges(xml_events.sums(xml_events.records(spark, _tagged_talks(spark, sf_dir), "c:talk")))


@_query("""SELECT '/talk' AS path, count(DISTINCT conv_id) AS n, 'id' AS attributes, 0::BIGINT AS n_text, false AS mixed FROM conversations HAVING count(*) > 0
UNION ALL SELECT '/talk/turn', count(*), 'role', count(*) FILTER (turn = 0), bool_or(turn = 0) FROM conversations HAVING count(*) > 0
UNION ALL SELECT '/talk/turn/nr', count(*), '', count(*), false FROM conversations HAVING count(*) > 0
UNION ALL SELECT '/talk/note', count(DISTINCT conv_id), 'kind, lang', 0, false FROM conversations WHERE conv_id % 3 = 0 HAVING count(*) > 0""")
def xml_graph_elements(spark, sf_dir):
    """Elements by path: their attributes, and which have text of their own beside children."""
    return xml_events.elements(xml_events.sums(xml_events.records(spark, _tagged_talks(spark, sf_dir), "c:talk"))).withColumn("attributes", F.array_join("attributes", ", "))


@_query("""WITH raw AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'NULL' WHEN c_custkey % 5 = 0 THEN '  ' || c_name || chr(9) ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN ' N/A ' ELSE '+1 (555) ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone, c_mktsegment AS segment FROM customer),
a AS (SELECT CASE WHEN trim(name, ' ' || chr(9)) <> 'NULL' THEN trim(name, ' ' || chr(9)) END AS name, CASE WHEN trim(phone) <> 'N/A' THEN regexp_replace(phone, '[^0-9]+', '', 'g') END AS phone, segment FROM raw)
""" + _each(["name", "phone", "segment"], "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, min({c}) AS low, max({c}) AS high FROM a"))
def preprocess_suggested(spark, sf_dir):
    """Steps suggested from a profile are applied, and the result is profiled again."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("+1 (555) "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    raw = table(spark, sf_dir, "customer").select(
        F.when(k % 7 == 0, "NULL").when(k % 5 == 0, F.concat(F.lit("  "), "c_name", F.lit("\t"))).otherwise(F.col("c_name")).alias("name"), F.when(k % 11 == 0, " N/A ").otherwise(phone).alias("phone"), F.col("c_mktsegment").alias("segment")
    )
    clean = preprocess.applied(raw, preprocess.suggested(raw))
    names = ["name", "phone", "segment"]
    ends = profile._batched(clean, names, lambda c: [F.min(c).alias("low"), F.max(c).alias("high")])
    return profile.counts(clean, names).select("column", "n_null", "n_distinct").join(profile.lengths(clean, names).select("column", "min_length", "max_length"), "column").join(ends, "column")


@_query("""SELECT 'old' AS "column", 'date' AS type, 'Date32' AS engine_type FROM orders HAVING count(*) > 0 UNION ALL SELECT 'old_time', 'timestamp64(ms)', 'DateTime64(3,''UTC'')' FROM orders HAVING bool_or(hour(o_orderdate::TIMESTAMP + to_hours((o_orderkey % 7)::INT)) > 0)""")
def engine_override(spark, sf_dir):
    """Times before 1970, which a plain date of ClickHouse doesn't hold; times after it need nothing."""
    d = F.col("o_orderdate")
    old = d - F.expr("INTERVAL '40' YEAR")
    o = table(spark, sf_dir, "orders").select(F.date_format(d, "yyyy-MM-dd").alias("new"), F.date_format(old, "dd.MM.yyyy").alias("old"), F.date_format(old + F.make_dt_interval(hours=F.col("o_orderkey") % 7), "yyyy-MM-dd HH:mm:ss").alias("old_time"), F.col("o_orderkey").cast("string").alias("number"))
    return infer.engine_overrides(o)


# --- databases -----------------------------------------------------------------------------------------


def _derby() -> str:
    """A database of the driver's own, in memory: the tasks of a local session reach it too."""
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS c_nationkey FROM customer")
def jdbc_load_and_upsert(spark, sf_dir):
    """Customers through staging into a database table, some of them replaced by a second load, a repeated one without effect; read back."""
    url, c = _derby(), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    database.create(spark, [ddl.Table("customer", (ddl.Column("c_custkey", "int64", False), ddl.Column("c_name", "string"), ddl.Column("c_nationkey", "int64")), ("c_custkey",))], url)
    database.load(c, url, "customer", "first")
    some = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("changed").alias("c_name"))
    for _ in range(2):
        database.load(some, url, "customer", "second", keys=("c_custkey",))
    return spark.read.format("jdbc").options(url=url, dbtable='"customer"').load()


@_query("""SELECT * FROM (SELECT 'talk' AS name, count(DISTINCT conv_id) AS n_rows, 'id' AS primary_key, '' AS parents FROM conversations
UNION ALL SELECT 'talk__turn', count(*), 'id', 'talk' FROM conversations) WHERE n_rows > 0""")
def xml_full_cycle(spark, sf_dir):
    """From an XML file to created, loaded and counted tables in two runs of which the first breaks off; keys are those that the database reports."""
    url, how = _derby(), (spark, _talks_file(spark, sf_dir), "talk", _folder(spark, "run"))
    cycle.run(*how, url, until="create")
    counted = cycle.run(*how, url)["counted"]
    rows = [(t.name, counted[t.name], ", ".join(t.primary_key), ", ".join(p for _, p, _ in t.foreign_keys)) for t in database.catalogue(spark, url) if t.name in counted]
    return spark.createDataFrame(rows, "name string, n_rows long, primary_key string, parents string")


# --- profiles ----------------------------------------------------------------------------------------


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@_query(_each(_ORDERS, "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, round(avg(({c} IS NULL)::INT), 6) AS null_fraction, round(count(DISTINCT {c}) / count(*), 6) AS uniqueness FROM orders"))
def profile_counts(spark, sf_dir):
    return profile.counts(table(spark, sf_dir, "orders"), _ORDERS)


@_query(_each(["c_custkey", "c_name"], "SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 100000 THEN count(DISTINCT {c}) END AS n_distinct, count(DISTINCT {c}) > 100000 AS capped FROM customer"))
def profile_capped_distinct(spark, sf_dir):
    return profile.capped_distinct(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"])


@_query(_each(_ORDERS, "SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 1000 THEN count(DISTINCT {c}) END AS n_distinct, count(DISTINCT {c}) > 1000 AS capped FROM orders"))
def capped_distinct(spark, sf_dir):
    """A cap that some columns pass and others don't."""
    return profile.capped_distinct(table(spark, sf_dir, "orders"), _ORDERS, 1000)


@_query("WITH l AS (SELECT l_partkey, l_suppkey, l_linenumber, nullif(l_linenumber, 7) AS l_seven FROM lineitem), " + "c AS (" + _each(["l_partkey", "l_suppkey", "l_linenumber", "l_seven"], "SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM l GROUP BY 2") + """)
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5('7:' || value), value) AS r FROM c WHERE value IS NOT NULL) WHERE r <= 50 UNION ALL SELECT * FROM c WHERE value IS NULL""")
def column_samples(spark, sf_dir):
    """Values that a seed picks, of several columns in one pass, with their whole counts."""
    df = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.expr("nullif(l_linenumber, 7)").alias("l_seven"))
    return bounded.samples(df, k=50, seed=7)


@_query("""WITH v AS (SELECT 'o_orderkey' AS "column", o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT 'text', CASE WHEN o_orderkey % 20 = 0 THEN 'n' || o_orderkey ELSE strftime(o_orderdate, '%d.%m.%Y') END FROM orders
  UNION ALL SELECT 'mostly', CASE WHEN o_orderkey % 50 = 0 THEN 'x' || o_orderkey ELSE strftime(o_orderdate, '%d.%m.%Y') END FROM orders),
c AS (SELECT "column", value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY md5('0:' || value)) AS r FROM v GROUP BY 1, 2),
s AS (SELECT "column", sum(n) FILTER (value SIMILAR TO '[0-9]+') / sum(n) AS num, sum(n) FILTER (value SIMILAR TO '[0-9.]+' AND contains(value, '.')) / sum(n) AS day, count(*) AS d, sum(n) AS n FROM c WHERE r <= 300 GROUP BY 1)
SELECT "column", CASE WHEN num = 1 THEN 'int32' WHEN day >= 0.95 THEN 'date' WHEN d / n <= 0.1 THEN 'lowcard_string' ELSE 'string' END AS type FROM s""")
def sampled_types(spark, sf_dir):
    """Types that most of a sample's values have."""
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, F.concat(F.lit("n"), "o_orderkey")).otherwise(day).alias("text"), F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("x"), "o_orderkey")).otherwise(day).alias("mostly"))
    return infer.threshold_types(o, sample=300)


@_query(_each(["c_name", "c_mktsegment"], "SELECT '{c}' AS \"column\", min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, quantile_disc(length({c}), 0.5)::INT AS p50, quantile_disc(length({c}), 0.95)::INT AS p95 FROM customer"))
def profile_lengths(spark, sf_dir):
    return profile.lengths(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])


@_query(_each(["l_quantity", "l_discount", "l_linenumber"], "SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4)::DOUBLE AS mean, round(stddev_samp({c}), 4)::DOUBLE AS stddev FROM lineitem"))
def profile_numbers(spark, sf_dir):
    return profile.numbers(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_linenumber"])


@_query("SELECT 'o_orderdate' AS \"column\", epoch(min(o_orderdate))::BIGINT AS min_epoch, epoch(max(o_orderdate))::BIGINT AS max_epoch FROM orders")
def profile_times(spark, sf_dir):
    return profile.times(table(spark, sf_dir, "orders"), ["o_orderdate"])


@_query(_each(["o_orderstatus", "o_orderpriority"], "SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 3"))
def profile_topk(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 3)


@_query("WITH t AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'x Z' ELSE 'x' END AS a, 'x' AS b, 'x+03:00' AS c FROM events) " + _each(["a", "b", "c"], "SELECT '{c}' AS \"column\", CASE avg((regexp_matches({c}, '(Z|\\+03:00)$'))::INT) WHEN 0 THEN 'none' WHEN 1 THEN 'offset_in_values' ELSE 'mixed' END AS tz FROM t"))
def profile_timezones(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return profile.timezones(e.select(F.when(F.col("event_id") % 2 == 0, F.concat(text, F.lit("Z"))).otherwise(text).alias("a"), text.alias("b"), F.concat(text, F.lit("+03:00")).alias("c")), ["a", "b", "c"])


@_query(_each(["o_orderkey", "o_custkey", "o_totalprice"], "SELECT * FROM (SELECT '{c}' AS \"column\", round(count(DISTINCT {c}) / count(*), 6) AS uniqueness, count(*) - count(DISTINCT {c}) AS conflicts FROM orders) WHERE uniqueness > 0.98"))
def candidate_keys_single(spark, sf_dir):
    return profile.candidate_keys(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@_query("SELECT 'event_id' AS column_a, 'user_id' AS column_b, round(count(DISTINCT (event_id, user_id)) / count(*), 6) AS uniqueness, count(*) - count(DISTINCT (event_id, user_id)) AS conflicts FROM events WHERE (SELECT count(DISTINCT user_id) / count(*) FROM events) > 0.001")
def candidate_keys_pair(spark, sf_dir):
    return profile.candidate_pairs(table(spark, sf_dir, "events"), ["event_id", "user_id"], 0.001)


@_query(_each(["l_returnflag", "l_linestatus", "l_linenumber"], "SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM lineitem) AS n_unique, {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR)::INT AS rank FROM lineitem GROUP BY {c}"))
def routing_signals(spark, sf_dir):
    return profile.routing_signals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"])


@_query(_each(["c_name", "c_mktsegment", "c_nationkey", "blank"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) = 1 AND avg(({c} IS NULL)::INT) < 0.99 AS constant, avg(({c} IS NULL)::INT) > 0.9 AS mostly_null, coalesce(bool_or(trim({c}::VARCHAR) <> {c}::VARCHAR), false) AS has_edge_spaces, count(DISTINCT {c}) BETWEEN 1 AND 256 AND avg(({c} IS NULL)::INT) < 0.95 AS low_cardinality FROM (SELECT *, ' x' AS blank FROM customer)"))
def anomalies(spark, sf_dir):
    return profile.anomalies(table(spark, sf_dir, "customer").withColumn("blank", F.lit(" x")), ["c_name", "c_mktsegment", "c_nationkey", "blank"])


@_query("WITH t AS (SELECT *, '+7 (900) ' || lpad(c_custkey::VARCHAR, 7, '0') AS phone FROM customer), s AS (" + _each(["phone", "c_mktsegment", "c_custkey"], "SELECT '{c}' AS \"column\", round(avg((length(regexp_replace({c}::VARCHAR, '\\D', '', 'g')) BETWEEN 11 AND 15)::INT), 6) AS p, round(avg(regexp_full_match({c}::VARCHAR, '[\\p{L}\\s''-]+')::INT), 6) AS n FROM t") + ") SELECT \"column\", p AS phone_share, n AS name_share, round(CASE WHEN p > 0.2 THEN 0.5 ELSE 0 END + CASE WHEN n > 0.2 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS risk FROM s")
def personal_data(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("phone", F.concat(F.lit("+7 (900) "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")))
    return profile.personal_data(c, ["phone", "c_mktsegment", "c_custkey"])


@_query("SELECT 'event_id' AS \"column\", true AS is_sorted UNION ALL SELECT 'user_id', (SELECT count(*) = 0 FROM (SELECT user_id < lag(user_id) OVER (ORDER BY event_id) AS f FROM events) WHERE f)")
def monotonic_check(spark, sf_dir):
    return profile.sorted_columns(table(spark, sf_dir, "events"), "event_id", ["event_id", "user_id"])


@_query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS hash FROM customer""")
def payload_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", profile.payload_hash(c, ["c_name", "c_custkey", "c_mktsegment"]).alias("hash"))


@_query(_each(["c_mktsegment", "c_nationkey"], "SELECT '{c}' AS \"column\", string_agg(v, ', ' ORDER BY o) AS examples FROM (SELECT {c}::VARCHAR AS v, min(c_custkey) AS o FROM customer GROUP BY 1 ORDER BY o LIMIT 3)"))
def profile_examples(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("c_mktsegment"), "c_nationkey")
    return profile.examples(c, "c_custkey", ["c_mktsegment", "c_nationkey"]).select("column", F.array_join("examples", ", ").alias("examples"))


@_query(_each(["kind", "user_id"], "SELECT '{c}' AS \"column\", count(DISTINCT coalesce({c}, '')) AS n_unique FROM (SELECT user_id::VARCHAR AS user_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS kind FROM events)"))
def profile_distinct_blank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 > 1, F.col("event_type")).alias("kind"))
    return profile.distinct_blank(e, ["kind", "user_id"])


@_query(_each(["a", "b"], "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR {c} = 'N/A') AS n_null, count(*) FILTER ({c} IS NULL OR {c} = 'N/A') > 0 AS nullable FROM (SELECT CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' ELSE event_type END AS a, event_type AS b FROM events)"))
def observed_nullability(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 == 1, " n/a").when(F.col("event_id") % 4 > 1, F.col("event_type")).alias("a"), F.col("event_type").alias("b"))
    return infer.nullability(e)


@_query("""SELECT 'key' AS "column", CASE WHEN max(length(o_orderkey::VARCHAR)) <= 9 THEN 'int32' ELSE 'int64' END AS type FROM orders
UNION ALL SELECT 'wide', CASE WHEN max(length((o_orderkey * 3000000000)::VARCHAR)) <= 9 THEN 'int32' ELSE 'int64' END FROM orders
UNION ALL SELECT 'price', 'decimal(' || (max(length(floor(o_totalprice)::BIGINT::VARCHAR)) + 2) || ',2)' FROM orders
UNION ALL SELECT 'day', CASE WHEN count(o_orderdate) = count(*) THEN 'date' END FROM orders
UNION ALL SELECT 'flag', CASE WHEN count(*) > 0 THEN 'bool' END FROM orders
UNION ALL SELECT 'moment', CASE WHEN count(*) > 0 THEN 'timestamp' END FROM orders
UNION ALL SELECT 'mixed', CASE WHEN count(DISTINCT o_orderkey % 2) = 2 THEN 'string' ELSE 'int32' END FROM orders""")
def xml_type_choice(spark, sf_dir):
    o, even = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 2 == 0
    return infer.xml_types(o.select(
        F.concat(F.lit(" "), "o_orderkey").alias("key"), (F.col("o_orderkey") * 3000000000).cast("string").alias("wide"), F.format_string("%.2f", F.col("o_totalprice").cast("double")).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(even, "true").otherwise("False").alias("flag"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("moment"), F.when(even, "12").otherwise("yes").alias("mixed"),
    ))


@_query(_each(_ORDERS, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders"))
def cardinality_report(spark, sf_dir):
    return profile.cardinalities(table(spark, sf_dir, "orders"), _ORDERS)


@_query(_each(_ORDERS, "SELECT * FROM (SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders) WHERE n_distinct >= (SELECT ceil(0.2 * count(*)) FROM orders)"))
def high_cardinality_columns(spark, sf_dir):
    n = profile.counts(table(spark, sf_dir, "orders"), _ORDERS)
    return n.where(F.col("n_distinct") >= F.ceil(F.col("n_rows") * 0.2)).select("column", "n_distinct")


# --- types -------------------------------------------------------------------------------------------


def _texts(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 10).cast("string").alias("whole"), (F.col("event_id") * 3000000000).cast("string").alias("wide"), F.concat(F.col("user_id") % 90, F.lit(",25")).alias("digits"), F.when(F.col("event_id") % 2 == 0, "да").otherwise("нет").alias("flag"),
        F.date_format("ts", "dd.MM.yyyy").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("moment"), "props", "event_type", F.lit(" N/A ").alias("nothing"),
    )


_INTS = "CASE WHEN max({0}) <= 2147483647 THEN 'int32' ELSE 'int64' END"
_DECIMAL = "'decimal(' || (max(length((user_id % 90)::VARCHAR)) + 2) || ',2)'"
_TYPED = {
    "whole": _INTS.format("event_id + 10"), "wide": _INTS.format("event_id * 3000000000"), "digits": _DECIMAL, "flag": "CASE WHEN count(*) > 0 THEN 'bool' END", "day": "CASE WHEN count(ts) > 0 THEN 'date' END",
    "moment": "CASE WHEN bool_or(epoch_ms(ts) % 1000 > 0) THEN 'timestamp64(ms)' WHEN bool_and(ts = date_trunc('day', ts)) THEN 'date' ELSE 'timestamp' END", "props": "CASE WHEN bool_and(json_valid(props)) THEN 'json' ELSE 'string' END",
    "event_type": "CASE WHEN bool_and(try_cast(event_type AS DOUBLE) IS NULL) THEN 'string' END", "nothing": "CASE WHEN count(*) > 0 THEN 'string' END",
}
_FEW = "CASE WHEN count(DISTINCT event_type) <= 5000 AND count(DISTINCT event_type) <= 0.1 * count(event_type) THEN 'lowcard_string' ELSE 'string' END"


def _typed_sql(kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {k} AS type FROM events" for c, k in kinds.items())


@_query(_typed_sql(_TYPED))
def type_choice(spark, sf_dir):
    return infer.strict_types(_texts(spark, sf_dir))


@_query(_typed_sql({**_TYPED, "event_type": _FEW, "nothing": "CASE WHEN count(*) > 0 THEN 'lowcard_string' END"}))
def lowcard_string_choice(spark, sf_dir):
    return infer.threshold_types(_texts(spark, sf_dir))


@_query("SELECT 'whole' AS \"column\", 'int64' AS type, 0.4::DOUBLE AS score, true AS ambiguous UNION ALL SELECT 'event_type', 'string', 1.0, false UNION ALL SELECT 'props', 'json', 0.642857, true")
def type_scores(spark, sf_dir):
    return infer.scored_types(_texts(spark, sf_dir), ["whole", "event_type", "props"])


@_query("""WITH t AS (SELECT event_id, event_id % 2 = 0 AS even, (props->>'k')::BIGINT AS k FROM events)
SELECT 'k' AS path, CASE WHEN bool_and(k BETWEEN -2147483648 AND 2147483647) THEN 'int32' ELSE 'int64' END AS type FROM t UNION ALL SELECT 'n', CASE count(DISTINCT even) WHEN 2 THEN 'int64' WHEN 1 THEN CASE WHEN bool_and(even) THEN 'int32' ELSE 'int64' END END FROM t
UNION ALL SELECT 'x', CASE WHEN bool_and(even) THEN 'int32' ELSE 'float64' END FROM t UNION ALL SELECT 's', CASE WHEN bool_and(NOT even) THEN 'int32' ELSE 'string' END FROM t UNION ALL SELECT 't', CASE WHEN bool_and(even) THEN 'timestamp' ELSE 'timestamp64(ms)' END FROM t""")
def json_type_lattice(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    e = table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").alias("k"), F.when(even, "7").otherwise("3000000000").alias("n"), F.when(even, "7").otherwise("7.5").alias("x"), F.when(even, '"a"').otherwise("1").alias("s"), F.when(even, '"2025-01-02T03:04:05Z"').otherwise('"2025-01-02T03:04:05.678Z"').alias("t")
    )
    return infer.json_profile(e).select(F.col("column").alias("path"), "type")


# --- nested data -------------------------------------------------------------------------------------


@_query("SELECT event_id AS rec_id, user_id AS \"who__id\", (props->>'k')::INT AS \"who__props__k\" FROM events")
def json_flatten_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.struct(F.col("user_id").alias("id"), F.from_json("props", "k int").alias("props")).alias("who")).alias("record"))
    return nested.entities(e, "event_id")[0].rows


def _talks(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.struct("conv_id", "turns").alias("record"))


@_query("SELECT conv_id AS rec_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS idx1, turn, role, text FROM conversations")
def json_array_child_table(spark, sf_dir):
    return nested.entities(_talks(spark, sf_dir), "conv_id")[1].rows


@_query("SELECT vec_id AS rec_id, unnest(range(1, len(embedding) + 1))::INT AS idx1, unnest(embedding)::DOUBLE AS value FROM embeddings")
def json_array_of_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.struct("embedding").alias("record"))
    return nested.entities(e, "vec_id")[1].rows.withColumn("value", F.col("value").cast("double"))


@_query("SELECT conv_id, turn, role, text FROM conversations")
def json_reassemble(spark, sf_dir):
    root, turns = nested.entities(_talks(spark, sf_dir), "conv_id")
    whole = nested.reassemble(root.rows, turns.rows, ["rec_id"], "idx1", "turns")
    return whole.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


@_query("SELECT conv_id, array_to_string(list(role ORDER BY turn, role, text), ' | ') AS roles FROM conversations GROUP BY conv_id")
def list_join(spark, sf_dir):
    return _talks(spark, sf_dir).select("conv_id", nested.joined_list(F.col("record.turns.role")).alias("roles"))


@_query("SELECT vec_id, a::DOUBLE AS a, b::DOUBLE AS b FROM (SELECT vec_id, unnest(embedding[1:3]) AS a, embedding FROM embeddings), unnest(embedding[4:5]) AS u(b)")
def list_explode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("a"), F.slice("embedding", 4, 2).alias("b"))
    return nested.exploded(e, ["a", "b"]).select("vec_id", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


@_query("SELECT '/root/item' AS parent, 'name' AS child, 1 AS min_children, 1 AS max_children, (SELECT count(*) FROM region) AS n_parents, false AS is_list UNION ALL SELECT '/root/item', 'nation', (SELECT min(n) FROM (SELECT count(*) n FROM nation GROUP BY n_regionkey)), (SELECT max(n) FROM (SELECT count(*) n FROM nation GROUP BY n_regionkey)), (SELECT count(DISTINCT n_regionkey) FROM nation), true UNION ALL SELECT '/root/item/nation', 'key', 1, 1, count(*), false FROM nation")
def xml_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"))).alias("nation"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("name"), "nation")
    path = _folder(spark, "xml")
    r.write.format("xml").option("rowTag", "item").option("rootTag", "root").save(path)
    records = documents.xml_records(spark, path, "item").select(F.struct("*").alias("record"))
    return nested.edges(records).select("parent", "child", F.col("min_children").cast("long").alias("min_children"), F.col("max_children").cast("long").alias("max_children"), "n_parents", "is_list")


# --- expectations ------------------------------------------------------------------------------------


@_query("SELECT (o_totalprice < 0 OR o_totalprice > 200000) AS rejected, count(*) AS n_rows FROM orders GROUP BY 1")
def range_check_split(spark, sf_dir):
    good, bad = quality.split(table(spark, sf_dir, "orders"), {"o_totalprice": (0, 200000)})
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(x).alias("rejected"), "n_rows") for df, x in ((good, False), (bad, True))]).where("n_rows > 0")


@_query("SELECT d.doc_id, 'quality is null' AS failed FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")
def not_null_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.split(d, required=["quality"])[1].select("doc_id", F.array_join("failed", ", ").alias("failed"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 3 <> 0)")
def fk_orphans(spark, sf_dir):
    return quality.orphans(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@_query("SELECT text, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.repeated_keys(table(spark, sf_dir, "documents"), ["text"])


@_query("""SELECT 'o_orderdate' AS "column", concat_ws(', ', 'ambiguous_types_present', CASE WHEN min(year(o_orderdate)) < 1970 THEN 'date32_recommended' END) AS flags FROM orders
UNION ALL SELECT 'constant', CASE WHEN count(*) > 0 THEN 'anomalies_detected' ELSE '' END FROM orders
UNION ALL SELECT 'old', concat_ws(', ', 'ambiguous_types_present', CASE WHEN min(year(o_orderdate) - 100) < 1970 THEN 'date32_recommended' END) FROM orders""")
def quality_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit("x").alias("constant"), F.date_format(F.col("o_orderdate") - F.expr("INTERVAL '100' YEAR"), "yyyy-MM-dd").alias("old"))
    return profile.quality_flags(o).select("column", F.array_join("flags", ", ").alias("flags"))


@_query("""WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS idx1, upper(role) AS role FROM conversations WHERE conv_id % 2 = 0)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS idx1, role FROM conversations WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, idx1, role FROM n""")
def child_upsert_composite(spark, sf_dir):
    rows = nested.entities(_talks(spark, sf_dir), "conv_id")[1].rows.select(F.col("rec_id").alias("conv_id"), "idx1", "role")
    return routing.upsert(rows, rows.where("conv_id % 2 = 0").withColumn("role", F.upper("role")), ["conv_id", "idx1"])


@_query("SELECT 'l_quantity' AS \"column\", min(l_quantity)::BIGINT AS low, max(l_quantity)::BIGINT AS high, 2::INT AS whole_digits, 1::INT AS scale FROM lineitem")
def profile_scales(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.format_string("%.1f", "l_quantity").alias("l_quantity"))
    return profile.scales(li, ["l_quantity"]).select("column", F.col("min").cast("bigint").alias("low"), F.col("max").cast("bigint").alias("high"), "whole_digits", "scale")


@_query(_each(["user_id", "value"], "SELECT '{c}' AS \"column\", count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::INT), 0) AS n_unique FROM (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 97 END AS value FROM events)"))
def profile_distinct_with_null(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 97).alias("value"))
    return profile.distinct_with_null(e)


@_query("""SELECT row_number() OVER (ORDER BY c.conv_id, turn, role, text) AS id, p.id AS talk_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn, role, text)::INT AS seq, turn, role
FROM conversations c JOIN (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS id FROM (SELECT DISTINCT conv_id FROM conversations)) p USING (conv_id)""")
def surrogate_keys(spark, sf_dir):
    return nested.surrogates(nested.entities(_talks(spark, sf_dir), "conv_id", name="talk"))[1].rows.select("id", "talk_id", "seq", "turn", "role")


@_query("SELECT event_id AS id, (props->>'k')::INT AS k, NULL::INT AS none FROM events")
def json_path_extract(spark, sf_dir):
    props = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tokens.json_path(props, ["k"], "int").alias("k"), tokens.json_path(props, ["k", "deeper"], "int").alias("none"))


@_query("SELECT event_type, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n_rows FROM events GROUP BY ALL")
def counts_by_hour(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n_rows")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n_rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
