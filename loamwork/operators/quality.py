"""Row-level expectations: ranges, required values, unique keys and foreign keys, with a dead letter for what fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators.profile import quoted


def failures(ranges: dict[str, tuple[float | None, float | None]] | None = None, required: list[str] | None = None) -> Column:
    """Names of the checks that a row fails, in order. A null passes a range check."""
    checks = [F.when(quoted(c).isNull(), F.lit(f"{c} is null")) for c in required or []]
    for c, (low, high) in (ranges or {}).items():
        bad = reduce(lambda a, b: a | b, [x for x in (None if low is None else quoted(c) < low, None if high is None else quoted(c) > high) if x is not None], F.lit(False))
        checks.append(F.when(bad, F.lit(f"{c} out of range")))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def split(df: DataFrame, ranges=None, required=None) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and dead letters with ``failed``, the checks they fail."""
    marked = df.withColumn("failed", failures(ranges, required))
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child rows without a parent; ``keys``: child column -> parent column. A null key is no orphan."""
    on = reduce(lambda a, b: a & b, [child[c] == parent[p] for c, p in keys.items()])
    some = reduce(lambda a, b: a & b, [child[c].isNotNull() for c in keys])
    return child.where(some).join(parent.select(*keys.values()), on, "left_anti")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with n_rows."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_loaded(df: DataFrame, keys: list[str]) -> None:
    """Fails when the table is empty or a key repeats."""
    if df.isEmpty():
        raise AssertionError("no rows were loaded")
    if not repeated_keys(df, keys).isEmpty():
        raise AssertionError(f"several rows share a key of {keys}")
