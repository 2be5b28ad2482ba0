"""Upserts into a table at rest that rewrite only the buckets of the keys that come.

A table is a Parquet folder partitioned by ``__bucket``, a hash of its key. An upsert reads and replaces the buckets that
the source has keys of (partition pruning, then dynamic partition overwrite); files of other buckets stay as they
are. The new buckets are computed and written to scratch space first, so what fails on the way leaves the table
untouched. Spark stages the replaced partitions too and moves them when the job is done; that last move is not one step, so
after a crash within it the same upsert is run once more: it gives the same table.

A key stands once in a table, so buckets are even, however often it comes. Rows with a null in their key meet nothing and are
added. Choose ``buckets`` so that one is some hundred MB.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loamwork.operators import routing
from loamwork.operators.profile import quoted
from loamwork.plans.scratch import materialise, release
from loamwork.sources import delimited, tables

BUCKETS, BUCKET, LAYOUT = 64, "__bucket", "_layout.json"


def _bucket(keys: list[str], buckets: int) -> Column:
    # Texts of the key: the same bucket whichever integer type a source has.
    return F.pmod(F.xxhash64(*[quoted(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition(BUCKET).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table of ``rows``, whose keys don't repeat."""
    _write(rows.withColumn(BUCKET, _bucket(keys, buckets)), path, "errorifexists")
    tables.write_text(rows.sparkSession, f"{path}/{LAYOUT}", json.dumps({"keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue()}))


def layout(spark: SparkSession, path: str) -> dict:
    return json.loads(delimited.sample_bytes(spark, f"{path}/{LAYOUT}", 1 << 24))


def read(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(layout(spark, path)["schema"])
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(path).select(*[quoted(c) for c in schema.names])


def touched(spark: SparkSession, path: str, source: DataFrame) -> list[int]:
    """The buckets that the source has keys of: at most as many numbers as there are buckets."""
    how = layout(spark, path)
    return sorted(r[0] for r in source.select(_bucket(how["keys"], how["buckets"])).distinct().collect())


def upsert(spark: SparkSession, path: str, source: DataFrame, ts: str | None = None, keep: tuple[str, ...] = ()) -> list[int]:
    """Put ``source`` (a row a key) into the table; the buckets that were replaced.

    As ``routing.upsert``; with ``ts`` as ``routing.upsert_newer``: only newer rows win. Columns that the table lacks are left out.
    """
    how = layout(spark, path)
    table = read(spark, path)
    source = source.select(*[quoted(c) for c in source.columns if c in table.columns])
    buckets = touched(spark, path, source)
    if not buckets:
        return []
    old = spark.read.schema(StructType([*table.schema.fields, StructField(BUCKET, IntegerType())])).parquet(path).where(F.col(BUCKET).isin(buckets)).drop(BUCKET)
    new = routing.upsert(old, source, how["keys"]) if ts is None else routing.upsert_newer(old, source, how["keys"], ts, keep)
    cells = [quoted(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    staged = materialise(new.select(*cells).withColumn(BUCKET, _bucket(how["keys"], how["buckets"])), "buckets")
    _write(staged, path, "overwrite")
    release(staged)
    return buckets
