"""Aggregates of bounded size, many columns in one pass: distinct counts up to a cap, and seeded samples of values.

A task keeps, for each column, the ``k`` distinct values whose hashes are smallest, with the rows they stand in. Such sketches merge: a value
among the k smallest of the whole is among those of every task that has it, so its count is whole. Up to k distinct values a sketch
is the exact table of values. At most k rows for each column and task are shuffled, and of these only what no task's own
k-th hash rules out. Memory is bounded by ``HELD`` values a pass: wide tables with a large k take several passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.profile import CAP, _names, quoted
from loamwork.plans.scratch import materialise

#: Values that a task holds at most.
HELD = 1_000_000
_OUT = "column string, hash string, value string, n long, full boolean"


def value_hash(value: str, seed: int = 0) -> str:
    """MD5 of seed:value, as other engines have it too."""
    return hashlib.md5(f"{seed}:{value}".encode(), usedforsecurity=False).hexdigest()


class Smallest:
    """The ``k`` values of smallest hash, and how often each came; ``full`` once a larger one was let go."""

    def __init__(self, k: int, seed: int):
        self.k, self.seed, self.full, self.nulls = k, seed, False, 0
        self.kept: dict[str, list] = {}  # value: [hash, n]
        self.most = None  # no hash from here on is kept

    def add(self, values: pa.Array) -> None:
        self.nulls += values.null_count
        counts = pc.value_counts(values.drop_null())
        for value, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
            if (held := self.kept.get(value)) is not None:
                held[1] += n
            elif self.most is None or (h := value_hash(value, self.seed)) < self.most:
                self.kept[value] = [value_hash(value, self.seed) if self.most is None else h, n]
                if len(self.kept) > 2 * self.k:
                    self.cut()

    def cut(self) -> None:
        if len(self.kept) > self.k:
            order = sorted(self.kept, key=lambda v: (self.kept[v][0], v))
            self.most, self.full = self.kept[order[self.k]][0], True
            for v in order[self.k :]:
                del self.kept[v]


def _sketches(columns: list[str], k: int, seed: int, values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Smallest(k, seed) for _ in columns]
        for batch in batches:
            for i, s in enumerate(found):
                if values or not s.full:
                    s.add(batch.column(i))
                    if not values:
                        s.cut()
        for name, s in zip(columns, found, strict=True):
            s.cut()
            rows = [(h, v, n) for v, (h, n) in s.kept.items()] if values or not s.full else []
            rows.append((max(h for h, _ in s.kept.values()) if s.full else None, None, s.nulls))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([s.full] * len(rows), pa.bool_())],
                names=["column", "hash", "value", "n", "full"],
            )

    return run


def _found(df: DataFrame, columns: list[str] | None, k: int, seed: int, values: bool) -> DataFrame:
    """Every task's sketches; without ``values`` none of a column that is over its cap, and a task stops counting there."""
    names, out = columns or df.columns, None
    at_once = max(1, HELD // (2 * k))
    for low in range(0, len(names), at_once):
        some = names[low : low + at_once]
        cells = df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(some)])
        rows = cells.mapInArrow(_sketches(some, k, seed, values), _OUT)
        out = rows if out is None else out.unionByName(rows)
    return materialise(out, "sketches")


def distinct_up_to(df: DataFrame, columns: list[str] | None = None, cap: int = CAP) -> DataFrame:
    """column, n_distinct (null beyond ``cap``), capped. Counting a column stops in each task, and in all, where it passes the cap."""
    found = _found(df, columns, cap, 0, values=False)
    over = found.groupBy("column").agg(F.bool_or("full").alias("over"))
    some = found.where("value is not null").join(F.broadcast(over.where("not over")), "column")  # a row a column
    n = some.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    out = _names(df, columns).join(F.broadcast(over), "column", "left").join(F.broadcast(n), "column", "left")  # a row a column
    n, capped = F.coalesce("n", F.lit(0)), F.coalesce("over", F.lit(False))
    return out.select("column", F.when(~capped & (n <= cap), n).alias("n_distinct"), (capped | (n > cap)).alias("capped"))


def samples(df: DataFrame, columns: list[str] | None = None, k: int = 10_000, seed: int = 0) -> DataFrame:
    """column, value, n: of each column the ``k`` distinct values that ``seed`` picks, with the rows they stand in, and a row for nulls.

    The same values however the table is stored; all of them where a column has no more than ``k``.
    """
    found = _found(df, columns, k, seed, values=True)
    # No value beyond a full task's last hash, which its row for nulls carries, is among the smallest of all.
    bounds = found.where("value is null and full").groupBy("column").agg(F.min("hash").alias("most"))
    near = found.where("value is not null").join(F.broadcast(bounds), "column", "left").where("most is null or hash <= most")  # a row a column
    per = near.groupBy("column", "hash", "value").agg(F.sum("n").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("hash", "value"))).where(F.col("r") <= k)
    nulls = found.where("value is null").groupBy("column", "value").agg(F.sum("n").alias("n")).where("n > 0")
    return ranked.select("column", "value", "n").unionByName(nulls)
