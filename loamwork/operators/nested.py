"""Nested records as related tables, and back.

A record's objects become prefixed columns of its table (``a__b``); each array becomes a child table keyed by
the record's ordinal and the 1-based places down to it. Works on any DataFrame with structs and arrays, so
JSON and XML readers share it. An array inside an array stays one JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.operators.profile import quoted

ROOT = "__root__"


@dataclass(frozen=True)
class Entity:
    """One table: its name, path, parent's name, key columns, and rows."""

    name: str
    path: tuple[str, ...]
    parent: str | None
    keys: tuple[str, ...]
    rows: DataFrame


def flat_columns(value: Column, kind: T.StructType, prefix: str = "") -> tuple[list[Column], list[tuple[str, Column, T.ArrayType]]]:
    """Scalar columns of a struct, and its arrays with their names."""
    scalars, arrays = [], []
    for f in kind.fields:
        name, inner = f"{prefix}{f.name}", value.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            more, deeper = flat_columns(inner, f.dataType, f"{name}__")
            scalars += more
            arrays += deeper
        elif isinstance(f.dataType, T.ArrayType):
            arrays.append((name, inner, f.dataType))
        else:
            scalars.append(inner.alias(name))
    return scalars, arrays


def entities(df: DataFrame, rec_id: str, value: str = "record", name: str = ROOT) -> list[Entity]:
    """The tables of records held in one struct column, parents first. ``rec_id`` numbers the records."""
    out: list[Entity] = []

    def walk(rows: DataFrame, own: str, path: tuple[str, ...], parent: str | None, keys: tuple[str, ...]) -> None:
        kind = rows.schema["__v"].dataType
        if not isinstance(kind, T.StructType):
            opaque = F.to_json("__v") if isinstance(kind, T.ArrayType) else F.col("__v")
            out.append(Entity(own, path, parent, keys, rows.select(*keys, opaque.alias("value"))))
            return
        scalars, arrays = flat_columns(F.col("__v"), kind)
        out.append(Entity(own, path, parent, keys, rows.select(*keys, *scalars)))
        for child, items, _ in arrays:
            index = f"idx{len(keys)}"
            below = rows.select(*keys, F.posexplode(items).alias("__p", "__v")).select(*keys, (F.col("__p") + 1).alias(index), "__v")
            walk(below, f"{own}__{child}", (*path, *child.split("__")), own, (*keys, index))

    walk(df.select(quoted(rec_id).alias("rec_id"), quoted(value).alias("__v")), name, (), None, ("rec_id",))
    return out


def reassemble(parent: DataFrame, child: DataFrame, keys: list[str], index: str, into: str) -> DataFrame:
    """The child's rows as an array, in order, on their parent's row; no rows give an empty array."""
    cells = [c for c in child.columns if c not in (*keys, index)]
    lists = child.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, F.struct(*[quoted(c) for c in cells]).alias("v")))), lambda x: x["v"]).alias(into))
    kind = lists.schema[into].dataType
    return parent.join(lists, keys, "left").withColumn(into, F.coalesce(F.col(into), F.array().cast(kind)))


def joined_list(items: Column, separator: str = " | ") -> Column:
    """A list as one text; an empty or null list is an empty text."""
    return F.coalesce(F.array_join(F.transform(items, lambda x: x.cast("string")), separator, ""), F.lit(""))


def exploded(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each combination of the lists' items; an empty list gives one null."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(quoted(c)))
    return df


def _field(name: str):
    return lambda x: x.getField(name)


def under(items: Column, kind: T.DataType, names: list[str]) -> tuple[Column, T.DataType]:
    """All values under a path of field names, in document order, lists on the way taken apart: an array, and its items' type."""
    items = F.array(items) if not isinstance(kind, T.ArrayType) else items
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    for name in names:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return F.array().cast("array<string>"), T.StringType()
        inner = kind[name].dataType
        found = F.transform(F.filter(items, lambda x: x.isNotNull()), _field(name))
        if isinstance(inner, T.ArrayType):
            found, inner = F.flatten(F.filter(found, lambda x: x.isNotNull())), inner.elementType
        items, kind = F.filter(found, lambda x: x.isNotNull()), inner
    return F.coalesce(items, F.array().cast(T.ArrayType(kind))), kind


def first_text(value: Column, kind: T.DataType, path: list[str] | None = None) -> Column:
    """The text of the first element under ``path``; without one, of the nearest scalar: fields of one level before deeper ones."""
    if path is not None:
        found, own = under(value, kind, path)
        text = F.get(found, F.lit(0))
        if isinstance(own, T.StructType):
            text = text.getField("_value") if "_value" in own.names else F.lit(None)
        return F.nullif(F.trim(text.cast("string")), F.lit(""))
    level, texts = [(value, kind)], []
    while level:
        deeper = []
        for v, k in level:
            if isinstance(k, T.ArrayType):
                v, k = F.get(v, F.lit(0)), k.elementType
            if isinstance(k, T.StructType):
                deeper += [(v.getField(f.name), f.dataType) for f in k.fields]
            elif isinstance(k, T.ArrayType):
                deeper.append((v, k))
            else:
                texts.append(F.nullif(F.trim(v.cast("string")), F.lit("")))
        level = deeper
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


def leaf_paths(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Field names down to every scalar of a type, lists taken apart."""
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, path)
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, (*path, f.name))]
    return [path]


def path_lists(df: DataFrame, value: str = "record", keep: list[str] | None = None) -> DataFrame:
    """Every leaf of a record as a column of texts in document order: ``a/b``, attributes ``a/b@name`` (fields that begin with an underscore)."""
    kind = df.schema[value].dataType

    def name(path: tuple[str, ...]) -> str:
        *above, last = path
        if last == "_value":
            return "/".join(above)
        return "/".join(above) + "@" + last[1:] if last.startswith("_") else "/".join(path)

    texts = lambda p: F.filter(F.transform(under(quoted(value), kind, list(p))[0], lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))), lambda x: x.isNotNull())
    return df.select(*[quoted(c) for c in keep or []], *[texts(p).alias(name(p)) for p in leaf_paths(kind)])


def attributes(df: DataFrame, value: str = "record", root: str = "/root/item") -> DataFrame:
    """path, attributes: the names of the attributes that elements of each path were seen with."""
    kind = df.schema[value].dataType
    found = [p for p in leaf_paths(kind) if p[-1].startswith("_") and p[-1] != "_value"]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, attributes array<string>")
    seen = df.agg(*[F.coalesce(F.bool_or(F.size(under(quoted(value), kind, list(p))[0]) > 0), F.lit(False)).alias(f"a{i}") for i, p in enumerate(found)])
    rows = F.array(*[F.struct(F.lit("/".join([root, *p[:-1]])).alias("path"), F.lit(p[-1][1:]).alias("name"), F.col(f"a{i}").alias("seen")) for i, p in enumerate(found)])
    return seen.select(F.explode(rows).alias("x")).select("x.*").where("seen").groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("attributes"))


def edges(df: DataFrame, value: str = "record", root: str = "/root/item") -> DataFrame:
    """Parent path, child, least and most children of a parent, and whether the child is a list.

    The children of one parent path come from one aggregation.
    """
    stats = []

    def walk(rows: DataFrame, path: str) -> None:
        kind, ns, names = rows.schema["v"].dataType, [], []
        for f in kind.fields:
            if not f.name.startswith("_"):  # attributes and text
                inner = F.col("v").getField(f.name)
                ns.append(F.coalesce(F.size(inner), F.lit(0)) if isinstance(f.dataType, T.ArrayType) else F.when(inner.isNotNull(), 1).otherwise(0))
                names.append(f.name)
        if names:
            one = rows.agg(*[F.struct(F.lit(path).alias("parent"), F.lit(c).alias("child"), F.min(n).alias("min_children"), F.max(n).alias("max_children"), F.count_if(n > 0).alias("n_parents")).alias(f"e{i}") for i, (c, n) in enumerate(zip(names, ns, strict=True))])
            stats.append(one.select(F.explode(F.array(*[F.col(f"e{i}") for i in range(len(names))])).alias("e")).select("e.*", (F.col("e.max_children") > 1).alias("is_list")))
        for f in kind.fields:
            if f.name.startswith("_"):
                continue
            many, inner = isinstance(f.dataType, T.ArrayType), F.col("v").getField(f.name)
            element = f.dataType.elementType if many else f.dataType
            if isinstance(element, T.StructType):
                walk(rows.select((F.explode(inner) if many else inner).alias("v")).where("v is not null"), f"{path}/{f.name}")

    walk(df.select(quoted(value).alias("v")), root)
    if not stats:  # no element has any below it
        return df.sparkSession.createDataFrame([], "parent string, child string, min_children int, max_children int, n_parents long, is_list boolean")
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Rows numbered from 1 along ``order``, without bringing them into one task.

    Rows are dealt to ranges of ``order`` and numbered within; a range starts after all rows of the ranges before
    it, of which there are as many as shuffle partitions.
    """
    from loamwork.plans.scratch import materialise

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [quoted(c) for c in order]
    dealt = materialise(df.repartitionByRange(n, *cells).withColumn("__range", F.spark_partition_id()), "numbered")
    before = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(F.col("__range").alias("__of"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*cells))
    return dealt.withColumn("__i", inside).join(F.broadcast(before), F.col("__of") == F.col("__range")).withColumn(name, F.col("__before") + F.col("__i")).drop("__range", "__i", "__of", "__before")


def surrogates(found: list[Entity]) -> list[Entity]:
    """The same tables keyed by ``id`` (document order), the parent's id as ``<parent>_id``, and ``seq`` within the parent.

    The names of generated columns give way to nothing: a field of the same name gets an underscore.
    """
    out: dict[str, Entity] = {}
    for e in found:
        made = ["id"] if e.parent is None else ["id", f"{e.parent}_id", "seq"]
        fields = [c for c in e.rows.columns if c not in e.keys]
        rows = e.rows.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(e.keys)], *[quoted(c).alias(f"{c}_" if c in made else c) for c in fields])
        keys = [f"__k{i}" for i in range(len(e.keys))]
        rows = numbered(rows, keys)
        if e.parent is not None:
            up = out[e.parent].rows.select(*keys[:-1], F.col("id").alias(f"{e.parent}_id"))
            rows = rows.join(up, keys[:-1]).withColumn("seq", F.col(keys[-1]))
        out[e.name] = Entity(e.name, e.path, e.parent, ("id",), rows)
    return [Entity(e.name, e.path, e.parent, e.keys, e.rows.drop(*[c for c in e.rows.columns if c.startswith("__k")])) for e in out.values()]
