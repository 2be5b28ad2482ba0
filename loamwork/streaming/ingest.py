"""A stream of staging rows into route targets: late and repeated rows are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loamwork.operators import routing


def once(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: state is dropped when the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, ts: str, by: list[str], width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Rows for each window and key, complete once the watermark passes the window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n_rows")).select(F.col("w.start").alias("window_start"), *by, "n_rows")


def into_routes(stream: DataFrame, mapping: routing.Mapping, folder: str, checkpoint: str, order: tuple[str, ...] = ("load_ts",)) -> DataStreamWriter:
    """Each micro-batch through the mapping's routes, appended under its batch number: a repeated batch overwrites itself.

    Rows land with the values they are ordered by, so that a late row of a later batch stays older. A batch is
    reduced to its newest rows before it lands; where columns are taken one by one, all its rows land. A target's
    current rows are ``current(...)``: the newest of each key over all batches.
    """
    by = [f"__o{i}" for i in range(len(order))]

    def land(batch: DataFrame, number: int) -> None:
        dead = None
        for r in mapping.routes:
            rows = routing.picked(batch, r, order)
            if r.upsert_key and r.dedup != "column":
                rows = routing.newest(rows, list(r.upsert_key), by)
            rows, letter = routing.checked(rows, mapping, r)
            rows.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{r.into}/batch={number}")
            dead = letter if dead is None else dead.unionByName(letter)
        if dead is not None:
            dead.write.mode("overwrite").parquet(f"{folder}/__dead/batch={number}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def current(landed: DataFrame, keys: list[str], dedup: str = "row") -> DataFrame:
    """The newest landed row of each key, or with ``dedup="column"`` each column's newest value that is not null.

    Newest is by the order that rows landed with; of equals the later batch wins.
    """
    order = [*sorted((c for c in landed.columns if c.startswith("__o")), key=lambda c: int(c[3:])), "__batch"]
    return routing.newest(landed, keys, order, dedup).drop(*order, "batch")
