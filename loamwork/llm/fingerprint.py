"""Document fingerprints: a quartile bucket digest and a bounded difference score.

A window of five bytes slides over the text; three-byte combinations in it are hashed into 128 buckets.
The digest holds, for each bucket, which quartile of the bucket counts its count falls in (two bits), the
logarithm of the length and two ratios of the quartiles. Two digests differ by the sum of their buckets'
quartile steps (opposite quartiles weigh double) plus a bounded part for the header; likeness is 1 less
that difference over ``FAR``, at least 0.

Cases: a null text counts as empty; texts with the same bytes have the same digest; texts of under three
bytes have no triplets, so only their length tells them apart; very long texts are read whole. Null ids come
before all others, rows of one id are ordered by a hash of the text, and every row has a result. A table of
one row is its own neighbour; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import in_ranges
from loamwork.plans.scratch import materialise

BUCKETS = 128
#: A difference of this much or more is likeness 0; unrelated texts of one language are about so far apart.
FAR = 160.0
_PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))


def digest(raw: bytes) -> str:
    """70 hex digits: length, two quartile ratios, 128 quartiles."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint16)
    counts = np.zeros(BUCKETS, np.int64)
    for turn, (i, j) in enumerate(_PAIRS):
        if len(data) > j:
            n = len(data) - j
            mixed = (data[:n] * np.uint16(40503) + np.uint16(turn * 9973)) ^ (data[i : i + n] * np.uint16(30011)) ^ (data[j : j + n] * np.uint16(52361))
            mixed = (mixed ^ (mixed >> np.uint16(7))) * np.uint16(36969)
            counts += np.bincount(mixed >> np.uint16(9), minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (quartile.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1, dtype=np.uint8)
    length = min(255, round(12 * math.log(len(raw) + 1)))
    ratios = (q1 * 15 // q3 if q3 else 0, q2 * 15 // q3 if q3 else 0)
    return bytes([length, ratios[0], ratios[1]]).hex() + packed.tobytes().hex()


def difference(a: str, b: str) -> float:
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    spread = lambda z: (z[3:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    steps = np.abs(spread(x).astype(np.int16) - spread(y).astype(np.int16))
    head = np.minimum(np.abs(x[:3].astype(np.int16) - y[:3].astype(np.int16)), 12)
    return float(steps.sum() + 3 * (steps == 3).sum() + head.sum())


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / FAR)


def digest_column(text: Column) -> Column:
    """The digest of a text's UTF-8 bytes; null counts as empty."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([digest((x or "").encode()) for x in texts], dtype=object)

    return made(text)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_RANGES = _RESULT + ", part int, first_text string, last_text string"


def _row(doc_id, text: str, mark: str, following: str, following_mark: str) -> tuple:
    changed = edited(text, following)
    changed_mark = digest(changed.encode())
    return doc_id, len(text), hashlib.sha256(changed.encode()).digest(), bytes.fromhex(mark), bytes.fromhex(changed_mark), likeness(mark, changed_mark), likeness(mark, following_mark)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64", **({"part": "Int32"} if schema == _RANGES else {})})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order, each compared with the one after it. The first brings its text along as
    ``first_text``; the last one's results stay open, and it brings its own as ``last_text``."""
    held = None  # part, doc_id, text, digest, whether it is the first
    for batch in batches:
        rows = []
        for part, doc_id, text in zip(batch["part"], batch["doc_id"], batch["text"], strict=True):
            mark = digest(text.encode())
            if held:
                rows.append((*_row(held[1], held[2], held[3], text, mark), held[0], held[2] if held[4] else None, None))
            held = part, None if pd.isna(doc_id) else int(doc_id), text, mark, held is None
        yield _frame(rows, _RANGES)
    if held:
        part, doc_id, text, mark, alone = held
        yield _frame([(doc_id, len(text), None, bytes.fromhex(mark), None, None, None, part, text if alone else None, text)], _RANGES)


def _closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = (None if pd.isna(x) else int(x) for x in batch["doc_id"])
        yield _frame([_row(i, own, digest(own.encode()), following, digest(following.encode())) for i, own, following in zip(ids, batch["last_text"], batch["first_text"], strict=True)], _RESULT)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and both likenesses.

    Ids are dealt to ascending ranges. A range's last row is compared with the first of the next range that has
    any, the very last with the very first: two texts a range meet in a join, all others where they were sorted.
    """
    done = materialise(in_ranges(docs, id_col, text_col).mapInPandas(_compared, _RANGES), "fingerprints")
    firsts, lasts = done.where("first_text is not null").select("part", "first_text"), done.where("last_text is not null").select("part", "doc_id", "last_text")
    # One row a range, numbers alone.
    order = Window.orderBy("part")
    following = firsts.select("part").select(F.col("part").alias("of"), F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    closing = lasts.join(following, F.col("of") == F.col("part")).drop("part").join(firsts, F.col("next") == F.col("part")).select("doc_id", "last_text", "first_text")
    out = done.where("last_text is null").select(*[x.split()[0] for x in _RESULT.split(", ")]).unionByName(closing.mapInPandas(_closed, _RESULT))
    as_hex = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", as_hex("edited_sha256"), as_hex("fingerprint"), as_hex("edited_fingerprint"), "near_edited", "near_next")
