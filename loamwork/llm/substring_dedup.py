"""Substring deduplication: content-defined chunks by a gear rolling hash, repeated passages by digest.

Each text is cut at word ends where a gear hash of the last 32 bytes says so (chunks of ``SHORTEST`` to
``LONGEST`` bytes, about 30), so an insertion moves the cuts near it only. Where it says so nowhere within
``LONGEST`` bytes, the cut is where the hash is smallest: at a word end, or in text without white space at
any character's end. Every run of ``RUN`` chunks has
a 128-bit digest. A digest that occurs more than once marks a repeated passage; the passage stays where
it occurs first (smallest doc_id, then place) and is removed elsewhere, provided it is at least
``LEAST_WORDS`` words long as marked, a run of over ``LONGEST_WORD`` characters without white space counting
as a word for each ``WORD_CHARS`` of them. Edges of a passage shorter than a chunk stay.

Counting is a grouped minimum with partial aggregation, and marking is a join whose two sides are both
shuffled, so a passage of a third of all documents is split over tasks. Only a document's own marks meet
in one row.

Cases: null and empty texts have no chunks and stay as they are (null becomes empty); rows without a
doc_id stay unchanged and count nowhere; rows that repeat a doc_id are one document, so their common
passages are first occurrences in each, whether their texts are the same or not. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col
from loamwork.plans.scratch import materialise

SHORTEST, LONGEST, MASK, RUN, LEAST_WORDS = 12, 64, 0b11, 4, 24
#: A word with its space in characters, and how many a run without white space may have to be one word.
WORD_CHARS, LONGEST_WORD = 6, 18
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _gear(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: h = 2 h + gear[byte] modulo 2^32, for all places at once by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) <= step:
            break
        h[step:] += h[:-step] << np.uint32(step)  # the right side is read before it is written
    return h


def _ranked(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For a cut after each byte, smallest first: the hash at word ends, then that at other characters' ends, then all else."""
    rank = np.where(_SPACES[data], h >> np.uint32(1), h >> np.uint32(1) | np.uint32(1 << 31))
    rank[:-1][data[1:] & 0xC0 == 0x80] = 0xFFFFFFFF
    return rank


def cuts(raw: bytes, shortest: int = SHORTEST, longest: int = LONGEST, mask: int = MASK) -> list[int]:
    """Where chunks begin and end: 0, ..., len(raw). Cuts never split a character."""
    n = len(raw)
    if not n:
        return [0]
    data = np.frombuffer(raw, np.uint8)
    h = gear_hash(data)
    ends = np.flatnonzero(_SPACES[data] & ((h >> np.uint32(16)) & np.uint32(mask) == 0)) + 1
    out, last, rank = [0], 0, None
    for end in [*ends.tolist(), n]:
        while end - last > longest:
            if rank is None:
                rank = _ranked(data, h)
            last += longest - int(rank[last + shortest - 1 : last + longest][::-1].argmin())  # of equals the last
            out.append(last)
        if end - last >= shortest or end == n and end > last:
            out.append(end)
            last = end
    return out


def windows(raw: bytes, run: int = RUN) -> tuple[list[int], np.ndarray]:
    """The cuts, and the digest (two numbers) of each run of chunks; a shorter text is one run."""
    at = cuts(raw)
    chunks = len(at) - 1
    if not chunks:
        return at, np.zeros((0, 2), np.int64)
    ends = range(min(run, chunks), chunks + 1)
    found = b"".join([xxhash.xxh3_128_digest(raw[at[e - min(run, chunks)] : at[e]]) for e in ends])
    return at, np.frombuffer(found, "<i8").reshape(-1, 2)


def _digests(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, t (a hash of the text), place of every run of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            for low in range(0, len(ids), 500):
                found = [windows(t.as_py().encode())[1] for t in texts[low : low + 500]]
                lengths = [len(f) for f in found]
                both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths]) if lengths else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids[low : low + 500], lengths)), pa.array(np.repeat(hashes[low : low + 500], lengths)), pa.array(places)], names=["h1", "h2", "doc_id", "t", "place"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "t").mapInArrow(run, "h1 long, h2 long, doc_id long, t long, place int")


def n_words(raw: bytes) -> int:
    """Words of a passage, text without white space being counted by its characters."""
    return sum(1 if len(w) <= LONGEST_WORD or (n := len(w.decode())) <= LONGEST_WORD else n // WORD_CHARS for w in raw.split())


_OUT = "doc_id long, n_chars long, n_chunks int, n_repeated_chunks int, has_repeat boolean, n_removed_chars long, removed array<struct<start:int,end:int,first_doc_id:long>>, first_doc_ids array<long>, text string"


def _cleaned(doc_id, text: str, marks, least_words: int):
    """marks: (place, first_doc_id, h1) of the runs of this text that occur more than once."""
    if not len(marks):
        return doc_id, len(text), max(0, len(cuts(text.encode())) - 1), 0, False, 0, [], [], text
    raw = text.encode()
    at = cuts(raw)
    chunks = len(at) - 1
    width = min(RUN, chunks)
    shared, gone, first_of = np.zeros(chunks, bool), np.zeros(chunks, bool), np.full(chunks, -1, np.int64)
    seen = set()
    for place, first, h1 in sorted(marks):
        shared[place : place + width] = True
        if first != doc_id or h1 in seen:
            gone[place : place + width] = True
            first_of[place : place + width] = first
        seen.add(h1)

    def spans(flags: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        found = [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]
        return [(a, b) for a, b in found if n_words(raw[at[a] : at[b]]) >= least_words]

    removed, kept, last = [], [], 0
    for a, b in spans(gone):
        start, end = len(raw[: at[a]].decode()), len(raw[: at[b]].decode())
        removed.append({"start": start, "end": end, "first_doc_id": int(first_of[a])})
        kept.append(text[last:start])
        last = end
    kept.append(text[last:])
    alike = spans(shared)
    sources = sorted({int(first) for place, first, _ in marks if any(a <= place < b for a, b in alike)})
    return doc_id, len(text), chunks, int(sum(b - a for a, b in alike)), bool(alike), sum(r["end"] - r["start"] for r in removed), removed, sources, "".join(kept)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each row of ``docs``: its chunks, repeated chunks, removed passages and the text that is left."""
    own = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    repeated = _digests(own).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = materialise(repeated, "repeated-runs")
    marks = _digests(own).join(repeated, ["h1", "h2"]).select("doc_id", "t", F.struct("place", "first", "h1").alias("mark"))
    # Places are those of one text: rows that share an id keep their marks apart, and rows repeated whole have them once.
    marks = marks.groupBy("doc_id", "t").agg(F.collect_set("mark").alias("marks"))
    names = [x.split()[0] for x in _OUT.replace("struct<start:int,end:int,first_doc_id:long>", "struct").split(", ")]

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                _cleaned(None if pd.isna(i) else int(i), t, [] if m is None else [(x["place"], x["first"], x["h1"]) for x in m], least_words)
                for i, t, m in zip(batch["doc_id"], batch["text"], batch["marks"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return own.join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "marks").mapInPandas(clean, _OUT)
