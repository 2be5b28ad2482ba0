"""From a staging table to its targets: filter, project, keep the newest, upsert.

A route names its target, a condition, an expression for each target column, and the target's key. Newest
means by ``load_ts`` and then by an ordinal, so equal times have one winner. Two ways to keep the newest:
``row`` takes the whole newest row of a key; ``column`` takes each column's newest value that is not null.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import tokens
from loamwork.operators import quality
from loamwork.operators.profile import quoted
from loamwork.plans.scratch import materialise


@dataclass(frozen=True)
class Route:
    into: str
    select: dict[str, str]
    when: str = "true"
    upsert_key: tuple[str, ...] = ()
    dedup: str = "row"


@dataclass(frozen=True)
class Mapping:
    """Typed source columns, routes and the staging table's name."""

    staging_table: str
    select_schema: dict[str, str]
    routes: tuple[Route, ...]
    ranges: dict[str, dict[str, tuple]] = field(default_factory=dict)
    required: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, doc: dict) -> Mapping:
        routes = tuple(Route(r["into"], dict(r["select"]), str(r.get("when") or "true"), tuple(r.get("upsert_key") or ()), r.get("dedup", "row")) for r in doc["route"])
        return cls(doc["staging_table"], dict(doc["select_schema"]), routes)


def lint(mapping: Mapping, tables: dict[str, dict[str, str]]) -> list[str]:
    """What is wrong with a mapping, given the targets' columns; nothing if it can run."""
    found = [] if mapping.select_schema else ["select_schema is empty"]
    for r in mapping.routes:
        if r.into not in tables:
            found.append(f"{r.into}: no such table")
            continue
        found += [f"{r.into}: no column {c}" for c in r.select if c not in tables[r.into]]
        found += [f"{r.into}: key column {c} is not selected" for c in r.upsert_key if c not in r.select]
    return found


def staging(raw: DataFrame, schema: dict[str, str], rules: tokens.TokenRules = tokens.CSV, load_ts: Column | None = None, src_file: Column | None = None) -> DataFrame:
    """All-text rows as typed columns, with src_file and load_ts; columns that are missing are null."""
    cells = [(tokens.parse_value(quoted(c), kind, rules) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c, kind in schema.items()]
    return raw.select(*cells, (F.lit(None).cast("string") if src_file is None else src_file).alias("src_file"), (F.current_timestamp() if load_ts is None else load_ts).alias("load_ts"))


def _condition(when: str) -> str:
    return "true" if when.strip() in ("", "1") else when


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by the columns of ``order``: one pre-aggregated maximum, no sort of the whole table.

    A null in the order is older than any value; a null key is a key like any other.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max(F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[quoted(c) for c in rest]).alias("row")))
    out = df.groupBy(*[quoted(k) for k in keys]).agg(newest.alias("__newest"))
    return out.select(*[quoted(k) for k in keys], *[F.col("__newest.row").getField(c).alias(c) for c in rest]).select(*[quoted(c) for c in df.columns])


def newest_values(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key, each column's newest value that is not null."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[quoted(c) for c in order])
    return df.groupBy(*[quoted(k) for k in keys]).agg(*[F.max_by(quoted(c), F.when(quoted(c).isNotNull(), by)).alias(c) for c in rest]).select(*[quoted(c) for c in df.columns])


def picked(staged: DataFrame, r: Route, order: tuple[str, ...] = ("load_ts",)) -> DataFrame:
    """The rows that a route takes, with the values of ``order`` as __o0, __o1 and so on."""
    return staged.where(_condition(r.when)).select(*[F.expr(e).alias(c) for c, e in r.select.items()], *[quoted(c).alias(f"__o{i}") for i, c in enumerate(order)])


def newest(rows: DataFrame, keys: list[str], order: list[str], dedup: str = "row") -> DataFrame:
    """One row a key, by whole rows or column by column."""
    return (newest_values if dedup == "column" else newest_rows)(rows, keys, order)


def route(staged: DataFrame, r: Route, order: tuple[str, ...] = ("load_ts",)) -> DataFrame:
    """The rows of one route; with a key, its newest ones."""
    own = picked(staged, r, order)
    if r.upsert_key:
        own = newest(own, list(r.upsert_key), [f"__o{i}" for i in range(len(order))], r.dedup)
    return own.select(*[quoted(c) for c in r.select])


def run(mapping: Mapping, staged: DataFrame, order: tuple[str, ...] = ("load_ts",)) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Every route's rows that pass their checks, and the dead letters (target, failed, the row as JSON).

    With several routes the staging rows are written down first: what made them (parsing, casts) is done once, and each route reads its own columns.
    """
    if len(mapping.routes) > 1:
        staged = materialise(staged, mapping.staging_table)
    out, dead = {}, None
    for r in mapping.routes:
        out[r.into], letter = checked(route(staged, r, order), mapping, r)
        dead = letter if dead is None else dead.unionByName(letter)
    return out, dead


def checked(rows: DataFrame, mapping: Mapping, r: Route) -> tuple[DataFrame, DataFrame]:
    """A route's rows that pass its target's checks, and its dead letters."""
    good, bad = quality.split(rows, mapping.ranges.get(r.into), list(mapping.required.get(r.into, ())))
    return good, bad.select(F.lit(r.into).alias("target"), "failed", F.to_json(F.struct(*[quoted(c) for c in r.select])).alias("payload"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's values where both have a key, and the source's other rows.

    Columns that the source lacks keep the target's values, and are null in new rows. Null keys never meet. A key
    must not repeat in the source (``newest`` sees to that).
    """
    t, s = target.withColumn("__there", F.lit(1)).alias("t"), source.withColumn("__here", F.lit(1)).alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    here = F.col("s.__here").isNotNull()

    def cell(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.`{c}`")
        if c not in target.columns:
            return F.col(f"s.`{c}`")
        return F.when(here, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`"))

    columns = [*target.columns, *(c for c in source.columns if c not in target.columns)]
    return t.join(s, on, "full_outer").select(*[cell(c).alias(c) for c in columns])


def upsert_newer(target: DataFrame, source: DataFrame, keys: list[str], ts: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``upsert``, but a source row wins only if the target's time is null or older; ``keep`` columns stay when the source's is null."""
    on = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"s.`{k}`") for k in keys])
    there, here = F.col("t.__there").isNotNull(), F.col("s.__here").isNotNull()
    t, s = target.withColumn("__there", F.lit(1)).alias("t"), source.withColumn("__here", F.lit(1)).alias("s")
    wins = here & (~there | F.col(f"t.`{ts}`").isNull() | (F.col(f"s.`{ts}`") > F.col(f"t.`{ts}`")))

    def cell(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.`{c}`")
        new = F.coalesce(F.col(f"s.`{c}`"), F.col(f"t.`{c}`")) if c in keep else F.col(f"s.`{c}`")
        return F.coalesce(F.col(f"t.`{c}`"), F.col(f"s.`{c}`")) if c in keys else F.when(wins, new).otherwise(F.col(f"t.`{c}`"))

    return t.join(s, on, "full_outer").select(*[cell(c).alias(c) for c in target.columns])


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """A route whose columns are all keys: present keys stay as they are."""
    on = reduce(lambda a, b: a & b, [source[k] == target[k] for k in keys])
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*[quoted(k) for k in keys]), on, "left_anti"), allowMissingColumns=True)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows of every table."""
    each = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)
