"""Keyed stream state: the newest row of each key, or each column's newest value, kept between micro-batches.

State holds one row a key, so a batch costs what arrives with it, not what ever arrived. Rows are compared by their order
values, wherever they come from: a late row of a later batch stays older. What changed in a batch comes out
once a key and is put into a table at rest (``sources.bucketed``); a batch that is run again after a failure starts from the state
before it and puts the same rows once more.

State of a key is dropped ``keep`` after its newest row's event time, once the watermark has passed that. Rows older than the
watermark are dropped by Spark, so a key that comes back is compared with nothing it could be older than, given ``keep`` of at least ``delay``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, TimestampType

from loamwork.operators import routing
from loamwork.sources import bucketed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _age(values: tuple) -> tuple:
    """Order values that compare; null is older than any."""
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


class Newest(StatefulProcessor):
    """One row a key: ``rest`` and ``order`` are columns by name; with ``by_column`` each of ``rest`` has an order of its own."""

    def __init__(self, schema: StructType, keys: list[str], order: list[str], by_column: bool, event_time: str, keep_ms: int):
        self.names, self.keys, self.order, self.by_column, self.event_time, self.keep_ms = schema.names, keys, order, by_column, event_time, keep_ms
        self.rest = [c for c in schema.names if c not in keys]
        # Each value with the order of the row it is from; whole rows share one, in column mode every column has its own.
        fields = [StructField(f"v{i}", schema[c].dataType) for i, c in enumerate(self.rest)]
        groups = range(len(self.rest)) if by_column else range(1)
        self.schema = StructType([*fields, *[StructField(f"o{g}_{k}", schema[c].dataType) for g in groups for k, c in enumerate(order)]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n, width = len(self.rest), len(self.order)
        held = list(self.state.get()) if self.state.exists() else None
        values = held[:n] if held else [None] * n
        ages = [tuple(held[n + g * width : n + (g + 1) * width]) for g in range(n if self.by_column else 1)] if held else [None] * (n if self.by_column else 1)
        changed = False
        for r in rows:
            age = tuple(r[c] for c in self.order)
            if not self.by_column:
                if ages[0] is None or _age(age) >= _age(ages[0]):
                    values, ages, changed = [r[c] for c in self.rest], [age], True
                continue
            for i, c in enumerate(self.rest):
                if r[c] is not None and (ages[i] is None or values[i] is None or _age(age) >= _age(ages[i])):
                    values[i], ages[i], changed = r[c], age, True
            changed |= held is None
        if changed:
            none = (None,) * width
            self.state.update((*values, *[v for a in ages for v in (a or none)]))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if (at := values[self.rest.index(self.event_time)]) is not None:
                self.handle.registerTimer(at // 1000 + self.keep_ms)
            found = dict(zip(self.rest, values, strict=True)) | dict(zip(self.keys, key, strict=True))
            yield Row(**{c: found[c] for c in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB state store."""
    spark.conf.set(_PROVIDER, _ROCKS)


def newest(stream: DataFrame, keys: list[str], order: list[str], event_time: str, dedup: str = "row", delay: str = "1 hour", keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """The stream's columns, once a key and batch that changed its newest row (or, with ``dedup="column"``, a column's newest value).

    ``order`` and ``event_time`` are columns of the stream other than its keys; of rows with equal order the later one wins.
    """
    use_rocksdb(stream.sparkSession)
    # Times go through state as microseconds, which compare alike wherever they come from.
    times = [f.name for f in stream.schema.fields if f.dataType == TimestampType()]
    coded = stream.select(*[(F.unix_micros(f"`{c}`") if c in times else F.col(f"`{c}`")).alias(c) for c in stream.columns], F.col(f"`{event_time}`").alias("__event_time"))
    schema = StructType([f for f in coded.schema.fields if f.name != "__event_time"])
    rows = coded.withWatermark("__event_time", delay)
    found = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).transformWithState(Newest(schema, keys, order, dedup == "column", event_time, keep_ms), schema, "Update", "EventTime")
    return found.select(*[(F.timestamp_micros(f"`{c}`") if c in times else F.col(f"`{c}`")).alias(c) for c in stream.columns])


def routed(stream: DataFrame, r: routing.Route, order: tuple[str, ...] = ("load_ts",), event_time: str = "load_ts", **how) -> DataFrame:
    """One keyed route over a stream of staging rows: what changed, with its order values as __o0, __o1 and so on."""
    rows = stream.where(routing._condition(r.when)).select(*[F.expr(e).alias(c) for c, e in r.select.items()], *[F.col(f"`{c}`").alias(f"__o{i}") for i, c in enumerate(order)], F.col(f"`{event_time}`").alias("__time"))
    return newest(rows, list(r.upsert_key), [f"__o{i}" for i in range(len(order))], "__time", r.dedup, **how)


def into_table(changes: DataFrame, path: str, checkpoint: str, keys: list[str], buckets: int = bucketed.BUCKETS) -> DataStreamWriter:
    """Each batch's changes into a bucketed table, which the first batch creates; columns that begin with ``__`` are not stored."""
    stored = [c for c in changes.columns if not c.startswith("__")]

    def land(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch.select(*[F.col(f"`{c}`") for c in stored])
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{bucketed.LAYOUT}")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            bucketed.create(rows.limit(0), path, keys, buckets)
        bucketed.upsert(spark, path, rows)

    return changes.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
