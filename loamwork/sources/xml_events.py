"""The structure of XML by its events: no schema is inferred, and no document is held as a tree.

Texts (whole documents, or the records that ``records`` cuts out of large files) are parsed where they are; each task adds up what
it sees of every path, and only these sums, a few rows a path, are shuffled. Names are local: prefixes and namespace
declarations are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OUT = "path string, child string, least long, most long, parents long, n long, attributes array<string>, texts long, mixed long"


def local(name: str) -> str:
    return name.rpartition(":")[2]


def records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """text: every element of one name, of files of any size, by ranges of bytes.

    The tag is given as it stands in the file, prefix included; its elements are neither empty tags nor inside each other. Spark hands the file
    out in pieces that end with the closing tag; what stands before an element's start is dropped.
    """
    end = f"</{row_tag}>"
    pieces = spark.read.option("lineSep", end).text(path)
    starts = F.regexp_instr("value", F.lit(f"<{re.escape(row_tag)}[\\s>]"))
    return pieces.select(F.concat(F.substr(F.col("value"), starts), F.lit(end)).alias("text")).where(starts > 0)


class Sums:
    """What one task has seen: by path its elements, attributes and texts; by path and child how many of it a parent has."""

    def __init__(self):
        self.n, self.texts, self.mixed, self.attributes, self.children, self.broken = Counter(), Counter(), Counter(), {}, {}, 0

    def add(self, text: str) -> None:
        """One document, or a sequence of elements; nothing of a text that is not well formed counts, but it is counted."""
        own, stack = Sums(), [["", Counter(), False]]

        def start(name: str, attributes: dict) -> None:
            parent = stack[-1]
            parent[1][local(name)] += 1
            path = f"{parent[0]}/{local(name)}"
            own.n[path] += 1
            found = {local(a) for a in attributes if a != "xmlns" and not a.startswith("xmlns:")}
            if found:
                own.attributes.setdefault(path, set()).update(found)
            stack.append([path, Counter(), False])

        def end(_: str) -> None:
            path, children, has_text = stack.pop()
            own.texts[path] += has_text
            own.mixed[path] += bool(has_text and children)
            for child, k in children.items():
                least, most, parents = own.children.get((path, child), (k, k, 0))
                own.children[path, child] = (min(least, k), max(most, k), parents + 1)

        def characters(data: str) -> None:
            stack[-1][2] |= not data.isspace()

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
        try:
            parser.Parse(text, True)
        except expat.ExpatError:
            self.broken += 1
            return
        self.merge(own)

    def merge(self, other: Sums) -> None:
        self.n += other.n
        self.texts += other.texts
        self.mixed += other.mixed
        for path, names in other.attributes.items():
            self.attributes.setdefault(path, set()).update(names)
        for key, (least, most, parents) in other.children.items():
            old = self.children.get(key, (least, most, 0))
            self.children[key] = (min(least, old[0]), max(most, old[1]), parents + old[2])

    def rows(self) -> list[tuple]:
        out = [(p, None, None, None, None, n, sorted(self.attributes.get(p, ())), self.texts[p], self.mixed[p]) for p, n in self.n.items()]
        out += [(p, c, *x, None, [], None, None) for (p, c), x in self.children.items()]
        return [*out, (None, None, None, None, None, self.broken, [], None, None)] if self.broken else out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums()
    for batch in batches:
        for text in batch.column(0):
            if (t := text.as_py()) is not None and t.strip():
                sums.add(t.lstrip("﻿ \t\r\n"))
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64())
    rows = sums.rows()
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def sums(texts: DataFrame, column: str = "text") -> DataFrame:
    """The partial sums of every task, for ``elements``, ``edges`` and ``broken``; a literal text is a table of one row."""
    from loamwork.operators.profile import quoted
    from loamwork.plans.scratch import materialise

    return materialise(texts.select(quoted(column).cast("string").alias("text")).mapInArrow(_sums, _OUT), "xml-sums")


def elements(found: DataFrame, root: str = "") -> DataFrame:
    """path, n, attributes (sorted), n_text (elements with text of their own), mixed (whether some have text and children)."""
    per = found.where("path is not null and child is null").groupBy("path").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("attributes")))).alias("attributes"), F.sum("texts").alias("n_text"), (F.sum("mixed") > 0).alias("mixed"))
    return per.withColumn("path", F.concat(F.lit(root), "path"))


def edges(found: DataFrame, root: str = "") -> DataFrame:
    """As ``nested.edges``: parent, child, min_children (0 where some parents lack the child), max_children, n_parents, is_list."""
    per = found.where("child is not null").groupBy(F.col("path").alias("parent"), "child").agg(F.min("least").alias("least"), F.max("most").alias("max_children"), F.sum("parents").alias("n_parents"))
    n = found.where("path is not null and child is null").groupBy(F.col("path").alias("parent")).agg(F.sum("n").alias("n"))
    least = F.when(F.col("n_parents") < F.col("n"), F.lit(0)).otherwise(F.col("least"))
    return per.join(n, "parent").select(F.concat(F.lit(root), "parent").alias("parent"), "child", least.cast("long").alias("min_children"), "max_children", "n_parents", (F.col("max_children") > 1).alias("is_list"))


def broken(found: DataFrame) -> int:
    """Texts that are not well formed."""
    return found.where("path is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
