"""Token ids in files of wavelet matrices, and the way back.

Texts are encoded as the tokenizers library does at its defaults (an added token in a text is that one
id; no special tokens are put around), an end id closes each document, and the ids of consecutive
documents (ascending id) fill shards of about ``SHARD`` tokens. A shard is one wavelet matrix: its own
alphabet, one bit-plane for each bit of the ids' places in that alphabet, each plane stably sorted by the
planes above it, with counts of ones before every block of 512 bits. ``access``, ``count`` and ``locate``
work on one shard through rank and select, without decoding it. Shards are rows of a Parquet table (so
Spark's commit protocol guards them, and any store that Spark writes can hold them), compressed with zstd.

A document is never split: a shard holds at least one document and at most ``SHARD`` tokens besides its
last document. Cases: a null text counts as empty and gives the end id alone; a very long one is encoded
whole; null ids come first; repeated ids stay separate, ordered by a hash of the text; an empty table gives an
empty file and an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.llm.common import in_ranges
from loamwork.plans.scratch import broadcast_if_small

SHARD, BLOCK = 1 << 16, 512
END_ID = 2
#: Words, and pieces of words, whose ids a task remembers: about 100 MB each at most.
REMEMBERED = 500_000
#: Tables of ranges up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


class WaveletMatrix:
    """Rank, access, count and locate over a sequence of ids."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: np.ndarray, planes: np.ndarray):
        """planes: one row of packed bits a level, the highest bit first; zeros: how many zeros each level has."""
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes
        self.levels = len(zeros)
        ones = np.bitwise_count(planes).astype(np.int64)
        width = BLOCK // 8
        padded = np.pad(ones, ((0, 0), (0, -ones.shape[1] % width)))
        sums = padded.reshape(self.levels, -1, width).sum(axis=2)
        self.before = np.concatenate([np.zeros((self.levels, 1), np.int64), np.cumsum(sums, axis=1)], axis=1)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids, minlength=1) > 0
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        place = np.cumsum(seen) - 1
        levels = max(1, int(len(alphabet) - 1).bit_length())
        x = place[ids].astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes = np.zeros(levels, np.int64), []
        for k in range(levels):
            bit = (x & (1 << (levels - 1 - k))) != 0
            planes.append(np.packbits(bit))
            low = np.compress(~bit, x)  # several times as fast as x[~bit]
            zeros[k] = len(low)
            x = np.concatenate([low, np.compress(bit, x)])
        return cls(len(ids), alphabet, zeros, np.stack(planes))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.alphabet), self.levels], "<u4").tobytes()
        return head + self.alphabet.astype("<u4").tobytes() + self.zeros.astype("<u4").tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, size, levels = np.frombuffer(raw, "<u4", 3)
        at = 12 + 4 * int(size)
        alphabet, zeros = np.frombuffer(raw, "<u4", int(size), 12), np.frombuffer(raw, "<u4", int(levels), at).astype(np.int64)
        planes = np.frombuffer(raw, np.uint8, offset=at + 4 * int(levels)).reshape(int(levels), -1)
        return cls(int(n), alphabet, zeros, planes)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        block, start = i // BLOCK, i // BLOCK * (BLOCK // 8)
        whole = int(np.bitwise_count(self.planes[level, start : i >> 3]).sum(dtype=np.int64))
        part = (int(self.planes[level, i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else 0
        return int(self.before[level, block]) + whole + part

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int, int]:
        place = int(np.searchsorted(self.alphabet, token))
        if place == len(self.alphabet) or self.alphabet[place] != token:
            return 0, 0, -1
        for k in range(self.levels):
            a, b = self._ones(k, start), self._ones(k, end)
            start, end = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if place >> (self.levels - 1 - k) & 1 else (start - a, end - b)
        return start, end, place

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        a, b, _ = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit, by binary search over rank."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def locate(self, token: int, nth: int) -> int | None:
        """Place of the nth (from 0) occurrence of a token, or None."""
        a, b, place = self._range(token, 0, self.n)
        if nth >= b - a:
            return None
        i = a + nth
        for k in reversed(range(self.levels)):
            bit = place >> (self.levels - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        # Each entry holds its place in the sequence, and below it the bits read so far.
        kind = np.uint32 if self.n <= 1 << (32 - self.levels) else np.uint64
        entries = np.arange(self.n, dtype=kind) << kind(self.levels)
        for k in range(self.levels):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            entries = np.concatenate([np.compress(~bit, entries), np.compress(bit, entries) | kind(1 << (self.levels - 1 - k))])
        places, values = entries >> kind(self.levels), entries & kind((1 << self.levels) - 1)
        out = np.empty(self.n, np.uint32)
        out[places] = self.alphabet[values]
        return out


#: The byte-level splitting pattern, with white space spelled as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII alone, which the plainer library splits several times as fast.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Byte-level files write a byte as the character of its number if that is visible in Latin-1, the others from 256 on, in order.
_VISIBLE = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_SPACE = chr(_VISIBLE[32])
#: White space and then a space: there a cut could change how the pattern splits.
_UNSAFE, _SAFE = re.compile(r" (?<=\s )"), re.compile(r"(?<=\S) ")


class WordEncoder:
    """Encodes texts with a byte-level tokenizers file, remembering the ids of words and of their pieces.

    A space after anything but white space starts a new match of the byte-level splitting pattern, so
    a text falls into words there, and each word's ids don't depend on the others. A new word is split by
    the pattern, a new piece goes through the tokenizer's merges. With ``added_tokens`` a text that holds
    one of the file's added tokens goes through the library whole, as those cut across words; without, they
    are plain text.
    """

    def __init__(self, tokenizer_file: str, added_tokens: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        tokenizer = Tokenizer.from_file(tokenizer_file)
        if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError(f"{tokenizer_file} is not plainly byte-level; its words can't be encoded apart")
        self.library, self.added = tokenizer.encode, [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.split, self.merge = regex.compile(PATTERN).findall, tokenizer.model.tokenize
        self.kind, self.width = ("<u2", 2) if tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", 4)
        self.words: dict[str, bytes] = {}  # a word stands for itself with a space before it
        self.pieces: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        out = []
        if not word.isascii():
            split = self.split(word)
        elif word[:1] == " " and word[1:].isalpha():
            split = (word,)
        else:
            split = _ASCII.findall(word)
        for piece in split:
            ids = self.pieces.get(piece)
            if ids is None:
                visible = piece.replace(" ", _SPACE) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_VISIBLE)
                ids = b"".join([t.id.to_bytes(self.width, "little") for t in self.merge(visible)])
                if len(self.pieces) < REMEMBERED:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian integers of ``kind``."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return np.array(self.library(text, add_special_tokens=False).ids, self.kind).tobytes()
        first, *rest = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        ids = list(map(self.words.get, rest))
        at = ids.index(None) if None in ids else -1
        while at >= 0:
            if (found := self.words.get(rest[at])) is None:
                found = self._whole(" " + rest[at])
                if len(self.words) < REMEMBERED:  # the common words come first
                    self.words[rest[at]] = found
            ids[at] = found
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                break
        return self._whole(first) + b"".join(ids) if first else b"".join(ids)


@lru_cache(maxsize=2)
def word_encoder(tokenizer_file: str, added_tokens: bool = False) -> WordEncoder:
    return WordEncoder(tokenizer_file, added_tokens)


_FILE = "part int, shard int, start_in_part long, n_ids long, doc_ids array<long>, n_tokens array<int>, matrix binary"
_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("matrix", pa.binary())])


def write_ids(docs: DataFrame, tokenizer_file: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text and write the shards to ``path``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_file, added_tokens=True)
        end, width = np.array([end_id], enc.kind).tobytes(), enc.width
        shard, start, part, held, ids, lengths, raw = 0, 0, None, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, start, held, ids, lengths, raw
            row = {"part": part, "shard": shard, "start_in_part": start, "n_ids": held, "doc_ids": ids, "n_tokens": lengths, "matrix": WaveletMatrix.build(np.frombuffer(b"".join(raw), enc.kind)).to_bytes()}
            shard, start, held, ids, lengths, raw = shard + 1, start + held, 0, [], [], []
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part  # a task has one range
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if held >= SHARD:
                    yield close()
                found = enc.encode(text.as_py())
                ids.append(doc_id)
                lengths.append(len(found) // width + 1)
                raw += [found, end]
                held += lengths[-1]
        if ids:
            yield close()

    in_ranges(docs, id_col, text_col).mapInArrow(shards, _FILE).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for before, ids, lengths, matrix in zip(batch["before"], batch["doc_ids"], batch["n_tokens"], batch["matrix"], strict=True):
            tokens = WaveletMatrix.from_bytes(matrix).decode().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in ids], "Int64"), "start": before + starts, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards alone: doc_id, start, n_tokens and ids_crc32 of every document."""
    file = spark.read.schema(_FILE).parquet(path)
    # One row a range of ids, numbers alone.
    before = file.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    return file.join(broadcast_if_small(before, SMALL), "part").select((F.col("earlier") + F.col("start_in_part")).alias("before"), "doc_ids", "n_tokens", "matrix").mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
