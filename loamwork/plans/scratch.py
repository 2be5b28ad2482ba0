"""Intermediate tables in the folder that the whole cluster shares.

``materialise`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and reads it back. That
cuts the lineage like ``checkpoint()``: a lost executor costs a re-read, not a recomputation. The table
that is read back carries no partitioning of its own, so a later join shuffles both of its sides and
adaptive execution may split a hot key's partition.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; only where it is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ours = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ours.isDefined():
            return ours.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes of the cluster share")
        root = f"file://{tempfile.mkdtemp(prefix='loamwork-')}"  # one machine: nothing else has to see it
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Spark's own setting: the shuffle files of a finished query are removed at once, not when the driver collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_LOCK, _WRITES = threading.Lock(), {}
_OWN: ContextVar[list | None] = ContextVar("own", default=None)


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting above while any thread writes; what it was before, after the last of them."""
    key = id(spark._jsparkSession)
    with _LOCK:
        n, before = _WRITES.get(key, (0, None))
        if not n:
            before = spark.conf.get(_CLEAN, "false")
            spark.conf.set(_CLEAN, "true")
        _WRITES[key] = (n + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITES[key]
            _WRITES[key] = (n - 1, before)
            if n == 1:
                spark.conf.set(_CLEAN, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared scratch space and read it back; its shuffle files go."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/loamwork/{name}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loamwork_path = path
    if (own := _OWN.get()) is not None:
        own.append(out)
    return out


@contextmanager
def scope() -> Iterator[None]:
    """All tables that are materialised within (by this thread) are deleted at the end: write results elsewhere before."""
    own: list[DataFrame] = []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        for table in own:
            release(table)


def release(table: DataFrame) -> None:
    """Delete a table that ``materialise`` returned; nothing may read it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._loamwork_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint when a count proves ``df`` small; otherwise ``df`` as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
