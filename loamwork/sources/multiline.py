"""Delimited text whose quoted cells span lines, read in as many tasks as text without.

Spark hands out lines by byte ranges (splits). Whether a line begins inside quotes depends on all before it, so each
split is first read as a function: what it ends in if it begins outside quotes, and if it begins inside. These
two-valued functions, one a split, are composed in file order, which says how each split begins; a second pass then
puts lines together to records. Only a record that crosses a split's end comes in fragments and is joined
from them.

A quote opens a cell at its start only, so one in the midst of an unquoted cell (``7,5" pipe``) is a character like any
other. After a closing quote everything up to the delimiter belongs to the cell. Splits that differ between the
two passes (files changed, or another number of cores) are noticed and refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.plans.scratch import materialise

#: Bytes that one record may have: beyond, its quote was never meant to open a cell.
LONGEST = 64 << 20
END = "\uffff".encode()
WHOLE, TAIL, THROUGH, HEAD = 0, 1, 2, 3


class Quotes:
    """Whether quotes are open after a line."""

    def __init__(self, delimiter: str = ","):
        self.delimiter = delimiter.encode()
        d = re.escape(self.delimiter)
        cell = rb'"[^"]*+(?:""[^"]*+)*+"[^' + d + rb"]*+|[^\"" + d + rb"][^" + d + rb"]*+|"
        self.opens = re.compile(rb"(?:(?:" + cell + rb")" + d + rb')*+"[^"]*+(?:""[^"]*+)*+\Z')
        self.inside = re.compile(rb'[^"]*+(?:""[^"]*+)*+')

    def after(self, line: bytes, inside: bool) -> bool:
        at = 0
        if inside:
            end = self.inside.match(line).end()
            if end == len(line):
                return True
            at = line.find(self.delimiter, end + 1) + 1
            if not at:
                return False
        return self.opens.match(line, at) is not None

    def hold(self, line: bytes, inside: bool, what: bytes) -> bool:
        """Whether ``what`` stands within quotes."""
        quoted = inside or line.startswith(b'"')
        at = int(quoted and not inside)
        while True:
            end = self.inside.match(line, at).end() if quoted else at
            if line.find(what, at, end) >= 0:
                return True
            at = line.find(self.delimiter, end + quoted) + 1
            if not at:
                return False
            quoted = line.startswith(b'"', at)
            at += quoted


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file (a hash of its path), start and length of the split, and the line's bytes; a task has a split's lines in order."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(file, start, length, rows) of each run of one split."""
    at = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
    edges = [0, *(np.flatnonzero(np.any(at[:, 1:] != at[:, :-1], axis=0)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield (*at[:, a].tolist(), batch.slice(a, b - a))


_SPLIT = "file long, start long, length long, outside boolean, inside boolean, breaks boolean"


def splits(spark: SparkSession, path: str, delimiter: str = ",", separator: str = "\n") -> dict[tuple[int, int], tuple[int, bool]] | None:
    """(file, start) -> (length, whether the split begins inside quotes); None where Spark's own reader gives the records, as no cell spans lines.

    That reader ends lines at carriage returns too, so a cell that has one spans lines even between line feeds, and the other way round; and records
    at U+FFFF. One row a split reaches the driver.
    """
    quotes, other = Quotes(delimiter), b"\n" if separator == "\r" else b"\r"

    def function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, back, breaks = None, False, True, False
        give = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, out, back, breaks), (pa.int64(),) * 3 + (pa.bool_(),) * 3, strict=True)], names=[c.split()[0] for c in _SPLIT.split(", ")])
        for batch in batches:
            for *at, rows in _runs(batch):
                if key != tuple(at):
                    if key is not None:
                        yield give()
                    key, out, back, breaks = tuple(at), False, True, False
                for line in rows.column(3).drop_null():
                    line = line.as_py()
                    breaks = breaks or END in line or (other in line and quotes.hold(line, out, other))
                    out, back = (quotes.after(line, out), quotes.after(line, back)) if out != back else (x := quotes.after(line, out), x)
                    breaks |= out
        if key is not None:
            yield give()

    # Lines without a quote change nothing: they go to the function as nulls.
    quoted = F.when(F.contains(F.col("line"), F.lit(b'"')) | F.contains(F.col("line"), F.lit(END)), F.col("line")).alias("line")
    found = lines(spark, path, separator).select("file", "start", "length", quoted).mapInArrow(function, _SPLIT).collect()
    begins, inside, last, any_ = {}, False, None, False
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        inside = inside and r.file == last
        begins[r.file, r.start] = (r.length, inside)
        any_ |= r.breaks or inside
        inside, last = (r.inside if inside else r.outside), r.file
    return begins if any_ else None


_RECORD = "file long, start long, kind int, record string"


def records(spark: SparkSession, path: str, begins: dict[tuple[int, int], tuple[int, bool]], delimiter: str = ",", separator: str = "\n", encoding: str = "utf-8", header: bool = False, longest: int = LONGEST) -> DataFrame:
    """record: every record's text, line breaks included; without each file's first one if it is a ``header``. ``begins`` is from ``splits``."""
    known, quotes, brk = spark.sparkContext.broadcast(begins), Quotes(delimiter), separator.encode()
    codec = "utf-8" if encoding == "utf-8-sig" else encoding

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, open_, kind, skip = None, False, [], TAIL, False

        def rows_of(at, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            text = [t.removesuffix(b"\r") if k in (WHOLE, HEAD) else t for k, t in found]
            keep = [i for i, t in enumerate(text) if found[i][0] != WHOLE or t.strip()]
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(keep), pa.int64()), pa.array([at[1]] * len(keep), pa.int64()), pa.array([found[i][0] for i in keep], pa.int32()), pa.array([text[i].decode(codec, errors="replace") for i in keep], pa.string())], names=["file", "start", "kind", "record"])

        for batch in batches:
            for *at, rows in _runs(batch):
                done, texts = [], rows.column(3)
                if key != tuple(at):
                    if open_:
                        yield rows_of(key, [(kind, brk.join(open_))])
                    key = tuple(at)
                    length, inside = known.value.get(key[:2], (None, False))
                    if length != key[2]:
                        raise ValueError("the splits of the file are not those of the pass over its quotes: read it anew under the same settings")
                    open_, kind, skip = [], THROUGH if inside else TAIL, header and key[1] == 0
                    first = texts[0].as_py()
                    if key[1] == 0 and first.startswith(b"\xef\xbb\xbf"):
                        texts = pa.concat_arrays([pa.array([first[3:]], pa.binary()), texts[1:]])
                quoted = pc.match_substring(texts, b'"').to_numpy(zero_copy_only=False)
                for line, has in zip(texts.to_pylist(), quoted, strict=True):
                    if has:
                        inside = quotes.after(line, inside)
                    if inside:
                        open_.append(line)
                        continue
                    if open_ or kind == THROUGH:
                        line = brk.join([*open_, line])
                    if skip and line.strip():
                        skip = False
                    else:
                        done.append((HEAD if kind == THROUGH else WHOLE, line))
                    open_, kind = [], TAIL
                yield rows_of(key, done)
        if open_:
            yield rows_of(key, [(kind, brk.join(open_))])

    found = lines(spark, path, separator).mapInArrow(assembled, _RECORD)
    if not any(inside for _, inside in begins.values()):
        return found.select("record")
    found = materialise(found, "records")
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    parts = found.where(F.col("kind") != WHOLE).withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    size = F.sum(F.octet_length("record"))
    joined = parts.groupBy("file", "nth").agg(F.when(size > longest, F.raise_error(F.lit("a quote that opens a cell is not closed within the longest record"))).otherwise(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", (-F.col("kind")).alias("k"), "record"))), lambda x: x["record"]), separator)).alias("record"))
    return found.where(F.col("kind") == WHOLE).select("record").unionByName(joined.select("record"))
