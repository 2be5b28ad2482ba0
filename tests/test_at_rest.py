"""Tables at rest and keyed stream state: what is rewritten, restarts, late and repeated rows, state that ends."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamwork.operators import routing
from loamwork.sources import bucketed
from loamwork.streaming import keyed


def files(path):
    return {p.relative_to(path).as_posix() for p in Path(path).rglob("*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, f"v{i}", i * 10, None if i % 3 else i) for i in range(40)], "id long, v string, at long, w long")
    bucketed.create(df, path, ["id"], 8)
    return path, df, f"{tmp_path}/t"


def test_only_buckets_of_the_keys_that_come_are_rewritten(spark, stored):
    path, df, folder = stored
    before = files(folder)
    source = spark.createDataFrame([(3, "new"), (100, "more")], "id int, v string")
    done = bucketed.upsert(spark, path, source)
    after = files(folder)
    assert 1 <= len(done) <= 2
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in done}
    assert kept and kept <= after and not (before - kept) & after
    assert rows_of(bucketed.read(spark, path)) == rows_of(routing.upsert(df, source, ["id"]))


def test_newer_rows_alone_win_and_what_the_source_lacks_stays(spark, stored):
    path, df, _ = stored
    source = spark.createDataFrame([(1, 5, 7), (2, 999, None), (3, 31, 8), (77, 1, 1)], "id long, at long, w long")
    bucketed.upsert(spark, path, source, ts="at", keep=("w",))
    got = {r.id: (r.v, r.at, r.w) for r in bucketed.read(spark, path).collect()}
    assert (got[1], got[2], got[3], got[77]) == (("v1", 10, None), ("v2", 999, None), ("v3", 31, 8), (None, 1, 1))
    assert rows_of(bucketed.read(spark, path)) == rows_of(routing.upsert_newer(df, source, ["id"], "at", ("w",)))


def test_what_fails_leaves_the_table(spark, stored):
    path, _, folder = stored
    before, rows = files(folder), rows_of(bucketed.read(spark, path))
    bad = spark.range(5).select(F.col("id"), F.when(F.col("id") == 4, F.raise_error(F.lit("no")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="no"):
        bucketed.upsert(spark, path, bad)
    assert files(folder) == before and rows_of(bucketed.read(spark, path)) == rows


def test_the_same_upsert_twice_and_none_and_null_keys(spark, stored):
    path, _, folder = stored
    source = spark.createDataFrame([(3, "new"), (None, "nobody")], "id long, v string")
    bucketed.upsert(spark, path, source.where("id is not null"))
    once = rows_of(bucketed.read(spark, path))
    bucketed.upsert(spark, path, source.where("id is not null"))
    assert rows_of(bucketed.read(spark, path)) == once
    before = files(folder)
    assert bucketed.upsert(spark, path, source.limit(0)) == [] and files(folder) == before
    bucketed.upsert(spark, path, source)
    assert len(rows_of(bucketed.read(spark, path).where("id is null"))) == 1


SCHEMA = "id long, a string, b string, ts timestamp"


def batch(folder, n, rows):
    (folder / "in").mkdir(exist_ok=True)
    text = "\n".join(json.dumps({"id": i, "a": a, "b": b, "ts": None if t is None else str(datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=t))}) for i, a, b, t in rows)
    (folder / "in" / f"{n}.json").write_text(text)


def run(spark, folder, dedup="row", **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{folder}/in")
    route = routing.Route("t", {"id": "id", "a": "a", "b": "b"}, "true", ("id",), dedup)
    changes = keyed.routed(stream, route, ("ts",), "ts", **{"delay": "1000 hours", **how})
    q = keyed.into_table(changes, f"file://{folder}/out", f"file://{folder}/cp", ["id"], 4).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


@pytest.mark.parametrize("dedup", ["row", "column"])
def test_state_equals_the_batch_route_over_restarts(spark, tmp_path, dedup):
    days = [[(1, "x", None, 5), (2, "y", "k", 5), (3, None, None, 1)], [(1, None, "late", 1), (2, None, "new", 9), (2, "y", "k", 5)], [(1, "z", None, 7), (4, "n", "m", 2), (None, "q", "r", 1)], [(1, "old", "older", 0), (4, None, None, 3), (5, "s", None, None)]]
    for n, rows in enumerate(days[:2]):
        batch(tmp_path, n, rows)
    run(spark, tmp_path, dedup)
    for n, rows in enumerate(days[2:], 2):  # a stopped query goes on from its checkpoint
        batch(tmp_path, n, rows)
    run(spark, tmp_path, dedup)
    every = spark.createDataFrame([(i, a, b, None if t is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=t)) for rows in days for i, a, b, t in rows], SCHEMA)
    want = routing.route(every, routing.Route("t", {"id": "id", "a": "a", "b": "b"}, "true", ("id",), dedup), ("ts",))
    assert rows_of(bucketed.read(spark, f"file://{tmp_path}/out")) == rows_of(want)


def test_state_of_a_key_ends(spark, tmp_path):
    batch(tmp_path, 0, [(1, "x", None, 0), (2, "y", None, 0)])
    batch(tmp_path, 1, [(2, "z", None, 50)])
    batch(tmp_path, 2, [(3, "w", None, 60)])
    batch(tmp_path, 3, [(3, "v", None, 61)])
    q = run(spark, tmp_path, delay="1 hour", keep_ms=10 * 3600 * 1000)
    held = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
    assert held[-1] < max(held) or held[-1] <= 2  # key 1 has gone, and what is stored stays
    assert rows_of(bucketed.read(spark, f"file://{tmp_path}/out")) == [(1, "x", None), (2, "z", None), (3, "v", None)]
