"""Tokenising, token files and fingerprints against the libraries and brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamwork.llm import bpe, common, fingerprint, wavelet

RANKS, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PARTS = ["a", "b'", "'s", " ", "  ", "\n", " \n", "\t", "1", "é", "ß", " ", "\x1c", "\x85", "!", "日", "😀", "́", "<|endoftext|>"]


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 24))) for _ in range(n)]


def test_pieces_encode_like_the_whole():
    enc = _tiktoken()
    for t in _texts(4000, 1):
        assert bpe.encode(enc, t, long=3) == enc.encode_ordinary(t) == bpe.encode(enc, t, long=1)
        assert [i for m in bpe.matches(P.PATTERN)(t) for i in enc._encode_single_piece(m)] == enc.encode_ordinary(t)


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "7", "!", "日", "。", "'", "\u00a0", " \n"])
def test_runs_of_two_million_characters(run):
    """The library alone overflows its stack on some of these; shorter ones it encodes alike."""
    enc = _tiktoken()
    text = "some words " + run * (2_000_000 // len(run)) + "x"
    assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()
    text = "some words " + run * 60_000 + " end"
    assert bpe.encode(enc, text, long=1000) == enc.encode_ordinary(text)


def test_very_long_runs_through_spark(spark):
    df = spark.createDataFrame([(1, "w " + " " * 1_500_000), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(("w " + " " * 1_500_000).encode()).hexdigest() and got[2].n_tokens == 1


def test_round_trip_digests_and_columns(awkward, nothing):
    enc = _tiktoken()
    got = bpe.round_trip(awkward, RANKS, P.PATTERN)
    assert set(awkward.columns) <= set(got.columns)
    for r in got.collect():
        ids = enc.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = awkward.select("text", bpe.encode_column(awkward["text"], RANKS, P.PATTERN).alias("ids"))
    for r in both.select("text", bpe.decode_column(both["ids"], RANKS, P.PATTERN).alias("raw")).collect():
        assert bytes(r.raw) == (r.text or "").encode()
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).collect() == []


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, v in ((1, 1), (1000, 7), (70_000, 50_000), (150_000, 9)):
        x = rng.integers(0, v, n).astype(np.uint16)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes())
        assert (w.decode() == x).all()
        for i in rng.integers(0, n, 20):
            assert w.access(int(i)) == x[i]
        for t in {*rng.integers(0, v, 10).tolist(), 60_000}:
            places = np.flatnonzero(x == t)
            assert w.count(int(t)) == len(places) and w.count(int(t), n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            assert [w.locate(int(t), k) for k in range(min(3, len(places)))] == places[:3].tolist()
            assert w.locate(int(t), len(places)) is None


def test_word_encoder_is_the_tokenizer():
    tokenizer = Tokenizer.from_file(FILE)
    enc = wavelet.word_encoder(FILE, added_tokens=True)
    long = ["w " + c * 100_000 + "x" for c in (" ", "\n", "a", "!", "日", " \n")]
    for t in [*_texts(4000, 2), *long]:
        assert enc.encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), repr(t)


def test_token_files(spark, awkward, nothing, tmp_path):
    tokenizer = Tokenizer.from_file(FILE)
    wavelet.write_ids(awkward, FILE, f"file://{tmp_path}/ids")
    got = wavelet.read_documents(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    wavelet.write_ids(nothing, FILE, f"file://{tmp_path}/none")
    assert wavelet.read_documents(spark, f"file://{tmp_path}/none").collect() == []


def test_added_tokens_are_encoded_as_the_library_does_by_default(spark, tmp_path):
    tokenizer = Tokenizer.from_file(FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "none here", *_texts(500, 3)]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    wavelet.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), FILE, f"file://{tmp_path}/ids")
    start = 0
    for r, (i, t) in zip(wavelet.read_documents(spark, f"file://{tmp_path}/ids").orderBy("start").collect(), enumerate(texts), strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        start += len(ids)


def _plain_digest(raw: bytes) -> str:
    """The digest by its description, one triplet at a time."""
    counts = [0] * 128
    for turn, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
        for at in range(len(raw) - j):
            h = (raw[at] * 40503 + turn * 9973) & 0xFFFF ^ raw[at + i] * 30011 & 0xFFFF ^ raw[at + j] * 52361 & 0xFFFF
            counts[((h ^ h >> 7) * 36969 & 0xFFFF) >> 9] += 1
    q = [sorted(counts)[32 * k - 1] for k in (1, 2, 3)]
    bits = "".join(f"{sum(c > x for x in q):02b}" for c in counts)
    head = [min(255, round(12 * math.log(len(raw) + 1))), q[0] * 15 // q[2] if q[2] else 0, q[1] * 15 // q[2] if q[2] else 0]
    return bytes(head).hex() + f"{int(bits, 2):064x}"


def _plain_likeness(a: str, b: str) -> float:
    x, y = ([int(h[k : k + 2], 16) for k in (0, 2, 4)] + [int(c) for d in h[6:] for c in (int(d, 16) >> 2 & 3, int(d, 16) & 3)] for h in (a, b))
    far = sum(min(12, abs(m - n)) for m, n in zip(x[:3], y[:3], strict=True)) + sum(abs(m - n) + 3 * (abs(m - n) == 3) for m, n in zip(x[3:], y[3:], strict=True))
    return max(0.0, 1 - far / 160)


def test_fingerprints_against_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i * 3, "".join(rng.choice(["ab", "the ", "é", "日", "x", "\n", "Qu"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(5000, rows[7][1]), (5001, None), (None, "one"), (None, "two"), (7, "twice"), (7, "twice"), (7, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.neighbours(df).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        assert _plain_digest((t or "").encode()) in {r.fingerprint for r in seen[i]}
    once = sorted((i, t or "") for i, t in rows if i not in (7, None))
    for (i, t), (_, following) in zip(once, once[1:] + once[:1], strict=True):
        if i in (6, 5001):  # their next documents are those of the repeated and the null ids
            continue
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        marks = [_plain_digest(x.encode()) for x in (t, changed, following)]
        assert tuple(seen[i][0])[1:] == (len(t), hashlib.sha256(changed.encode()).hexdigest(), marks[0], marks[1], _plain_likeness(marks[0], marks[1]), _plain_likeness(marks[0], marks[2])), i
    assert seen[5001][0].near_next in {_plain_likeness(_plain_digest(b""), _plain_digest(x)) for x in (b"one", b"two")}
    alone = fingerprint.neighbours(df.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_ranges_spread_equal_ids(spark):
    """Any number of rows may share an id: ranges hold about as many rows each, in order."""
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(4)
    got = common.in_ranges(df, rows=1000).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("part").collect()
    assert len(got) > 10 and max(r.n for r in got) < 4000
    ids = [x for r in got for x in (r.low, r.high) if x is not None]
    assert ids == sorted(ids)


def test_fingerprints_of_neighbours(awkward, nothing):
    rows = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.digest(t.encode()), fingerprint.digest(following.encode())))
    got = fingerprint.neighbours(awkward).collect()
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    nexts = {w[0]: fingerprint.likeness(w[3], w[4]) for w in want if w[0] != 3}
    assert {r.doc_id: r.near_next for r in got if r.doc_id != 3} == nexts
    assert fingerprint.neighbours(nothing).collect() == []


def test_likeness_orders_edits():
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "ion", "er", "ist", "ouf")]
    rng = random.Random(4)
    a, b = (" ".join(rng.choices(words, k=400)) for _ in range(2))
    small = a.replace(words[0], words[1], 3)
    mark = lambda t: fingerprint.digest(t.encode())
    assert fingerprint.likeness(mark(a), mark(a)) == 1
    assert fingerprint.likeness(mark(a), mark(small)) > fingerprint.likeness(mark(a), mark(b))


def test_digests_hold_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{i} some words " * 400 for i in range(400)] + [None, ""])
    enc = bpe.encoder(RANKS, P.PATTERN)
    tracemalloc.start()
    found = bpe.digested(enc, texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes // 2
    assert [x["n_tokens"] for x in found[-2:]] == [0, 0] and found[0]["n_tokens"] == len(enc.encode_ordinary(texts[0].as_py()))
