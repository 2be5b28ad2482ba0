"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each task builds the encoder once from the rank file. Texts over ``LONG`` characters are cut first where
the splitting pattern has a boundary whatever stands around it: where white space begins, a run of letters or
digits ends, or one of other characters (an apostrophe aside) does. What can't be cut so (one long run, of
blanks say) is split into the pattern's matches here and each match goes through the library's merges, as the
library's own splitting overflows its stack there. The pieces' ids joined are the whole text's ids.
Decoding joins the ids' raw bytes, so it never has to guess at broken characters.

Cases: a null or empty text has no ids and decodes to nothing; a very long one, of whatever characters, is
encoded whole. Strings of special tokens are ordinary text. Every input row stays (repeated ones, null ids),
and every column but those named like the results, which give way to them. An empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col

LONG = 100_000
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``long`` characters, cut only at safe boundaries."""
    start = 0
    while len(text) - start > long:
        cut = _SAFE.search(text, start + long)
        if not cut or cut.start() >= len(text):
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def matches(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches in a text; white space is spelled out as the two libraries' short forms differ."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def encode(enc: tiktoken.Encoding, text: str | None, long: int = LONG) -> list[int]:
    if not text:
        return []
    out: list[int] = []
    for piece in safe_pieces(text, long):
        if len(piece) <= 2 * long:
            out += enc.encode_ordinary(piece)
        else:
            for match in matches(enc._pat_str)(piece):
                out += enc._encode_single_piece(match)
    return out


def encode_column(text: Column, rank_file: str, pattern: str) -> Column:
    """array<int> of token ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(rank_file, pattern)
        for texts in batches:
            yield pd.Series([encode(enc, x) for x in texts], dtype=object)

    return ids(text)


def decode_column(ids: Column, rank_file: str, pattern: str) -> Column:
    """Raw bytes of an array of token ids."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(rank_file, pattern)
        for lists in batches:
            yield pd.Series([b"" if x is None else enc.decode_bytes([int(i) for i in x]) for x in lists], dtype=object)

    return decoded(ids)


def digested(enc: tiktoken.Encoding, texts: pa.Array) -> pa.Array:
    """n_tokens, ids_sha256 and decoded_sha256 of each text; one text at a time leaves Arrow's memory."""
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    n, of_ids, of_text = [], [], []
    for text in texts:
        ids = encode(enc, text.as_py())
        n.append(len(ids))
        of_ids.append(sha(np.asarray(ids, "<u4").tobytes()))
        of_text.append(sha(enc.decode_bytes(ids)))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of what they decode to."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(rank_file, pattern)
        for texts in batches:
            yield digested(enc, texts)

    kept = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.select(*map(col, kept), digests(col(text_col)).alias("__digests")).select(*map(col, kept), "__digests.*")
