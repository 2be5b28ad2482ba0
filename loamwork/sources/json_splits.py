"""One large JSON array, read in many tasks: elements with their places, whatever the file's line breaks.

Spark hands out a file in pieces that end with ``}`` (its text reader with that separator), so ranges of bytes (splits)
are read apart even where the whole file is one line. Whether a split begins within a string, and how
deep, depends on all before it. So each split is first read under both assumptions: what it ends in, how the depth
changes, and how many commas stand at each relative depth. Combined in file order, these say how every split begins and
how many elements come before; a second pass then cuts elements out. One that crosses a split's end comes in
fragments of one number and is joined from them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.plans.scratch import materialise
from loamwork.sources.multiline import _runs, lines

_OPEN, _CLOSE, _COMMA = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b"{[")], _KINDS[list(b"}]")], _KINDS[ord(",")] = _OPEN, _CLOSE, _COMMA
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]', re.S)


def array_start(raw: bytes, keys: list[str]) -> int | None:
    """Where the elements of the array under ``keys`` (of the top, if there are none) begin; None if ``raw`` has no such array."""
    stack, matched, name, pending = [], 0, None, not keys
    for m in _TOKEN.finditer(raw):
        t = m[0]
        if t == b"[" and pending and matched + 1 >= len(keys):
            return m.end()
        if not keys:
            return None  # the top is no array
        if t in (b"{", b"["):
            matched += t == b"{" and pending and matched + 1 < len(keys)
            stack.append(t)
        elif t in (b"}", b"]"):
            stack.pop()
            matched = min(matched, max(0, len(stack) - 1))
        elif t == b":" and len(stack) == matched + 1 and stack[-1] == b"{" and name == keys[matched].encode():
            pending = True
            continue
        elif t[:1] == b'"':
            name = t[1:-1]
        pending = False
    return None


def structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Brackets and commas of a text that begins outside a string: places, kinds, whether each is within a string, and whether the end is."""
    quotes = raw == 34
    slash = raw == 92
    if slash.any():
        at = np.flatnonzero(quotes[1:] & slash[:-1]) + 1
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
        quotes[at[(at - 1 - last[at - 1]) % 2 == 1]] = False
    kinds = _KINDS[raw]
    at = np.flatnonzero(kinds)
    before = np.cumsum(quotes, dtype=np.int64)
    return at, kinds[at], before[at] % 2 == 1, bool(before[-1] % 2) if len(raw) else False


def depths(kinds: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """The relative depth after each place."""
    return np.cumsum(np.where(outside, (kinds == _OPEN).astype(np.int32) - (kinds == _CLOSE), 0))


def _bytes(pieces: pa.Array) -> bytes:
    return b"}".join([*pieces.to_pylist(), b""])


_SPLIT = "file long, start long, length long, begin long, first string, ends array<boolean>, deep array<long>, least array<long>, commas array<map<int,long>>"


def _function(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, head = None, None, b""

        def fresh() -> dict:
            return {"begin": -1, "first": "", "ends": [False, True], "deep": [0, 0], "least": [0, 0], "commas": [Counter(), Counter()]}

        def give() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int32(), pa.int64())))
            row = (*key, state["begin"], state["first"], state["ends"], state["deep"], state["least"], [list(c.items()) for c in state["commas"]])
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["file", "start", "length", "begin", "first", "ends", "deep", "least", "commas"])

        for batch in batches:
            for *at, rows in _runs(batch):
                if key != tuple(at):
                    if key is not None:
                        yield give()
                    key, state, head = tuple(at), fresh(), b""
                raw = _bytes(rows.column(3))
                cut = 0
                if key[1] == 0 and state["begin"] < 0:
                    # The first split: nothing counts before its array begins.
                    head += raw
                    if (begin := array_start(head, keys)) is None:
                        continue
                    cut, state["begin"] = begin - (len(head) - len(raw)), begin
                    raw = head[begin:] if cut < 0 else raw[cut:]
                state["first"] = state["first"] or raw.lstrip()[:1].decode("latin-1")
                data = np.frombuffer(raw, np.uint8)
                places, kinds, within, odd = structure(data)
                for h in (0, 1):
                    outside = within == state["ends"][h]
                    deep = depths(kinds, outside) + state["deep"][h]
                    if len(deep):
                        # What closes the array ends the count: a comma after it is none of its own.
                        low = np.minimum(np.minimum.accumulate(deep), state["least"][h])
                        found = outside & (kinds == _COMMA) & (deep == low)
                        for d, n in zip(*np.unique(deep[found], return_counts=True), strict=True):
                            state["commas"][h][int(d)] += int(n)
                        state["least"][h] = min(state["least"][h], int(deep.min()))
                        state["deep"][h] = int(deep[-1])
                    state["ends"][h] ^= odd
        if key is not None:
            yield give()

    return run


def _in_order(spark: SparkSession, path: str) -> dict[int, int]:
    """file (as ``lines`` has it) -> its place among the files by path."""
    names = spark.read.format("binaryFile").load(path).select("_metadata.file_path")  # contents are not read
    return {r.file: k for k, r in enumerate(names.select("file_path", F.xxhash64("file_path").alias("file")).sort("file_path").collect())}


def begins(spark: SparkSession, path: str, keys: list[str], through: bool = False) -> dict[tuple[int, int], tuple[int, int, bool, int, int]] | None:
    """(file, start) -> (length, where its array begins, whether it begins within a string, depth below the array, elements begun before).

    Depth 0 is between elements; a split after the array's end has depth -1. One row a split reaches the driver.
    ``through``: elements of all files before, by path, come before. None where a file's first split has no such array.
    """
    out, file, inside, depth, place, first = {}, None, False, 0, 0, ""
    at = _in_order(spark, path) if through else {}
    for r in sorted(lines(spark, path, "}").mapInArrow(_function(keys), _SPLIT).collect(), key=lambda r: (at[r.file] if through else r.file, r.start)):
        if r.file != file:
            if r.begin < 0:
                return None
            # The last element of the file before has no comma after it; an empty array has no element.
            place = place + (first not in ("", "]")) if through else 0
            file, inside, depth, first = r.file, False, 0, ""
        out[r.file, r.start] = (r.length, r.begin, inside, depth, place)
        first = first or r.first
        h = int(inside)
        if depth >= 0:
            place += r.commas[h].get(-depth, 0)
            depth = -1 if depth + r.least[h] < 0 else depth + r.deep[h]
            inside = r.ends[h]
    return out


_ELEMENT = "file long, start long, rec_id long, whole boolean, text string"


def elements(spark: SparkSession, path: str, known: dict) -> DataFrame:
    """rec_id (1-based place in its file's array) and text of every element; ``known`` is from ``begins``."""
    at_ = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, place, open_, begun, skip = None, False, 0, 0, [], True, 0

        def give(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
            rows = [r for r in rows if not r[1] or r[2].strip()]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(rows), pa.int64()), pa.array([key[1]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2].decode("utf-8", errors="replace") for r in rows], pa.string())],
                names=["file", "start", "rec_id", "whole", "text"],
            )

        for batch in batches:
            for *at, rows in _runs(batch):
                if key != tuple(at):
                    if open_ and depth >= 0:
                        yield give([(place + 1, False, b"".join(open_))])
                    key, open_ = tuple(at), []
                    length, skip, inside, depth, place = at_.value.get(key[:2], (None, 0, False, 0, 0))
                    if length != key[2]:
                        raise ValueError("the splits of the file are not those of the first pass: read it anew under the same settings")
                    begun = key[1] == 0  # whether the element that is open began in this split
                    skip = max(0, skip)
                if depth < 0:
                    continue
                raw = _bytes(rows.column(3))
                if skip:
                    raw, skip = raw[skip:], max(0, skip - len(raw))
                places, kinds, within, odd = structure(np.frombuffer(raw, np.uint8))
                outside = within == inside
                deep = depths(kinds, outside) + depth
                over = np.flatnonzero(deep < 0)
                ends = np.flatnonzero(outside & (kinds == _COMMA) & (deep == 0))
                if len(over):
                    ends = np.append(ends[ends < over[0]], over[0])
                done, low = [], 0
                for end in places[ends].tolist():
                    text = raw[low:end] if not open_ else b"".join([*open_, raw[low:end]])
                    done.append((place + 1, begun, text))
                    place, low, open_, begun = place + 1, end + 1, [], True
                if len(over):
                    depth = -1
                else:
                    open_.append(raw[low:])
                    depth, inside = int(deep[-1]) if len(deep) else depth, inside ^ odd
                yield give(done)
        if open_ and depth >= 0:
            yield give([(place + 1, False, b"".join(open_))])

    found = lines(spark, path, "}").mapInArrow(cut, _ELEMENT)
    if len(known) == len({file for file, _ in known}):  # a split a file: no fragments
        return found.where("whole").select("rec_id", "text")
    found = materialise(found, "elements")
    parts = found.where("not whole").groupBy("file", "rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "").alias("text"))
    return found.where("whole").select("rec_id", "text").unionByName(parts.where("trim(text) <> ''").select("rec_id", "text"))
