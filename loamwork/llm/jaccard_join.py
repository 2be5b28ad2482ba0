"""N-gram Jaccard join by parity sketches: all pairs of shingle sets with Jaccard at least 0.75, as components.

A document's set is its distinct five-word shingles, hashed to 64 bits. Sets of similar size share a band;
a set may meet sets of its own band and, if it is near the band's lower end, of the band before. A band has
a number of parts P. Each shingle flips one bit of a sparse sketch of P parts; a part is named by the XOR
of its flipped bits' codes, so equal names mean equal parity bits. Two linked sets of a and b shingles differ
in at most k = (a + b) / 7 of them, the sketches' Hamming distance is at most that, and so at least P - k
parts are equal (pigeonhole). With all parts in one fixed order (fullest first), two such sets
therefore share a part among the first k + 1 of each, and m of them among the first k + m: only these are joined, and
pairs of long sets (where m is a sixteenth of the band's least size) that share fewer are no candidates.

A part's name tells its band, so a document that shares fewer than m parts of a band with all others together is left out before pairs are made.

Candidates are filtered by dense parity sketches (1024 bits within the join, about four bits a shingle after
it), whose Hamming distance also bounds the symmetric difference from below, and verified on the whole shingle
sets. Groups of copies never turn into all pairs:
1. equal sets are one class (the smallest doc_id stands for it);
2. in ``ROUNDS`` rounds each document is verified against one document of another component that holds the
   smallest id under a part they share, the one it shares most parts with; links merge components;
3. only documents that share a part across different components are then compared with each other. Where
   more than ``HOT`` documents share one (a passage that many unrelated documents quote), these documents
   are instead joined under another fixed order of parts, rarest among them first: a frequent part is then
   looked at only in documents that have fewer than k + 1 rarer ones.
Every linked pair is thus either verified or already in one component, so no component is missed. Before rows are shuffled, each task merges equal sets of a batch of documents.

Cases: fewer than five words are one shingle, the whole sequence; no words (or null) is an empty set, linked
with nothing; a null doc_id gets its n_shingles and no component; rows that repeat a doc_id are one document. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm import phrases
from loamwork.llm.common import col
from loamwork.plans.scratch import broadcast_if_small, materialise, release

WIDTH, ROUNDS, SHORT_BITS = 5, 3, 1024
#: Sets from this size on have a dense sketch of more than ``SHORT_BITS`` bits.
LONG = SHORT_BITS // 4
#: Documents under one part, beyond which they are joined by their rarest parts: about where comparing a document's
#: short sketch with that many others costs more than naming all of its parts and counting them.
HOT = 2000
#: Documents whose equal sets a task merges before rows are shuffled.
TOGETHER = 2000
#: Id tables up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
#: Short sketches (about 150 bytes each) that are broadcast, at most.
SHORT_SMALL = 50_000
#: Word hashes that a task remembers: about 50 MB at most.
REMEMBERED = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_WORDS = Words()


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    # bytes.lower() changes A-Z alone, bytes.split() splits at space and tab to carriage return alone.
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([_WORDS[x] for x in words], np.uint64)
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h += _mix(w[k : k + n] * _ODD[k] + np.uint64(k))
    return np.unique(_mix(h))


def bands(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, k) that a set of ``n`` meets others under: its own band, and the one before if it reaches down to it."""
    own = 0
    while 4 ** (own + 1) <= n:
        own += 1
    out = [(own, _parts(own), (n + n * 4 // 3) // 7)]
    below = 4**own - 1
    if own and 4 * below >= 3 * n:
        out.append((own - 1, _parts(own - 1), (n + below) // 7))
    return out


def _parts(band: int) -> int:
    """More than any k of the band, so that at least one part is equal."""
    return 3 * 4**band // 2 + 8


def _named(sets: np.ndarray, band: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the parts that have shingles, how many each has, and names of all empty parts, ascending. A name's last five bits are its band."""
    part = ((sets >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    full = np.diff(np.concatenate([starts, [len(sets)]]))
    names = np.bitwise_xor.reduceat(_mix(sets), starts)
    keys = _mix(names + _mix(part[starts] + np.uint64(band << 48)))
    empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts]) + np.uint64(band << 48)
    banded = lambda x: (x & ~np.uint64(31)) | np.uint64(band)
    return banded(keys), full, np.sort(banded(_mix(_mix(empty))))


def least_shared(band: int) -> int:
    """Parts that linked sets share at least among the first k + this many of each: more than one where sets are long."""
    return max(1, 4**band // 16) if 4**band >= LONG else 1


def part_keys(sets: np.ndarray) -> np.ndarray:
    """What the set is joined on: the names of its first k + ``least_shared`` parts in each of its bands."""
    out = []
    for band, parts, k in bands(len(sets)):
        if not k:  # nothing but an equal set can be linked
            continue
        keys, full, empty = _named(sets, band, parts)
        first = k + least_shared(band)
        if len(keys) > first:
            keys = keys[np.lexsort((keys, -full))[:first]]
        else:  # if too few parts have shingles, empty parts come last in the order
            keys = np.concatenate([keys, empty[: first - len(keys)]])
        out.append(keys)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(sets: np.ndarray) -> np.ndarray:
    """A dense parity sketch as bits: each shingle flips one of about four times as many bits as there are shingles."""
    bits = max(SHORT_BITS, 1 << int(4 * len(sets)).bit_length())
    return (np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """The sketch that the same shingles would have with fewer bits: the XOR of its parts."""
    return np.bitwise_xor.reduce(bits.reshape(-1, to), axis=0)


def short(bits: np.ndarray) -> np.ndarray:
    """The sketch folded to ``SHORT_BITS`` bits, as 64-bit numbers."""
    return np.packbits(folded(bits, SHORT_BITS)).view("<i8")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two packed sketches, the longer folded to the shorter."""
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum(dtype=np.int64))


_SETS = "doc_id long, n_shingles long, d1 long, d2 long, short array<long>, sketch binary, keys array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document. Of ``TOGETHER`` documents only the first of equal sets has keys."""
    for batch in batches:
        for low in range(0, len(batch), TOGETHER):
            yield _merged(batch.slice(low, TOGETHER))


def _merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = batch.column(0).to_pylist()
    sizes, digests, sketches, shorts, keys = [], [], [], [], []
    first: dict[bytes, int] = {}
    for i, text in zip(ids, batch.column(1), strict=True):
        s = shingles(text.as_py())
        digest = xxhash.xxh3_128_digest(s.tobytes())
        bits = sketch(s)
        sizes.append(len(s))
        digests.append(digest)
        sketches.append(np.packbits(bits).tobytes())
        shorts.append(short(bits))
        keys.append(part_keys(s) if i is not None and first.setdefault(digest, i) == i else np.zeros(0, np.uint64))
    ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
    d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(shorts, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SETS.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id) in order, each once, those whose key another document has too, with the key's first doc_id.

    A key with any number of rows takes no memory: only the last row waits for what follows it.
    """
    names = ["key", "doc_id", "pivot"]
    last, pivot, before = None, None, None  # the row that waits, its key's first doc_id, the key of the row before it
    for batch in batches:
        keys, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(keys):
            continue
        if last is not None:
            keys, ids = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], ids])
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
        keys, ids = keys[once], ids[once]
        same = keys[1:] == keys[:-1]
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        pivots = np.repeat(ids[starts], np.diff(np.concatenate([starts, [len(keys)]])))
        if keys[0] == before:  # the first run began in an earlier batch
            pivots[: starts[1] if len(starts) > 1 else len(keys)] = pivot
        as_before = np.concatenate([[keys[0] == before], same])
        keep = np.flatnonzero(as_before[:-1] | same)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep]), pa.array(pivots[keep])], names=names)
        before = keys[-2] if len(keys) > 1 else before
        last, pivot = (keys[-1], ids[-1]), pivots[-1]
    if last is not None and last[0] == before:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*last, pivot)], names=names)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "set": [shingles(t).tobytes() for t in batch["text"]]})


_PARTS = "doc_id long, own long, band int, first long, keys array<long>, empty array<long>"


def _all_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document's set (``own`` tells sets of one doc_id apart) and band: the names of all parts with
    shingles, and of as many empty ones as are needed to make the ``first`` ones that it is joined on.

    These parts are finer than others, at least four for each shingle, so that most hold one shingle: documents made of a shared
    passage and a third of their own then have k + 1 parts that hardly any other has.
    """
    for batch in batches:
        for low in range(0, len(batch), 500):
            rows = []
            for i, text in batch.iloc[low : low + 500][["doc_id", "text"]].itertuples(index=False):
                s = shingles(text)
                own = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                for band, _, k in bands(len(s)):
                    if k:
                        keys, _, empty = _named(s, band, 4 ** (band + 2))
                        first = k + least_shared(band)
                        rows.append((i, own, band, first, keys.view(np.int64), empty[: max(0, first - len(keys))].view(np.int64)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARTS.split(", ")])


def _others_too(marks):
    """Leaves out parts that no other document has by the map ``marks``, and asks for fewer ``first`` ones by their number.

    A part that is kept by chance is counted by the join that follows; rows that need no other part than their own go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            keys, first = [], []
            for k, n in zip(batch["keys"], batch["first"], strict=True):
                k = np.asarray(k, np.int64)
                slot = (k.view(np.uint64) >> np.uint64(8)) & np.uint64(phrases.BITS - 1)
                kept = k[(table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                keys.append(kept)
                first.append(n - len(k) + len(kept))
            batch = batch.assign(keys=keys, first=first)
            yield batch[batch["first"] > 0]

    return run


def rarest_parts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """key, doc_id: the first k + ``least_shared`` parts of every document of ``ids`` in each band, rarest among these documents first.

    The order is one for all of them (frequency, then name, empty parts last), so linked documents share a key.
    """
    parts = materialise(texts.join(broadcast_if_small(ids, SMALL), "doc_id", "left_semi").mapInPandas(_all_parts, _PARTS), "all-parts")
    often = materialise(parts.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "part-counts")
    # Most parts are one document's own: they come first in the order and need no place in it, only their number.
    spark = texts.sparkSession
    marks = spark.sparkContext.broadcast(phrases._bitmap(spark, often.select((F.shiftrightunsigned("key", 8) % phrases.BITS).alias("slot"))))
    named = parts.drop("empty").mapInPandas(_others_too(marks), "doc_id long, own long, band int, first long, keys array<long>").select("doc_id", "own", "band", "first", F.explode("keys").alias("key"))
    order = Window.partitionBy("doc_id", "own", "band").orderBy(F.coalesce("n", F.lit(1)), "key")
    first = named.join(often, "key", "left").withColumn("rank", F.row_number().over(order)).where("rank <= first and n > 1").select("key", "doc_id")
    return materialise(first.unionByName(parts.select(F.explode("empty").alias("key"), "doc_id")).distinct(), "rarest-parts")


def _enough(count):
    """Condition that so many equal parts of one band (column ``band``) are as many as linked sets share at least."""
    out = F.lit(True)
    for band in range(1, 20):
        if least_shared(band) > 1:
            out = F.when(F.col("band") == band, count >= least_shared(band)).otherwise(out)
    return out


def _band():
    """The band that a part's name (column ``key``) tells."""
    return F.col("key").bitwiseAND(31).alias("band")


def _needed(x: str, y: str):
    """``least_shared`` of two sides' common band: the smaller one's own."""
    n = F.least(f"{x}.n", f"{y}.n")
    out = F.lit(1)
    for band in range(1, 20):
        if least_shared(band) > 1:
            out = F.when(n >= 4**band, F.lit(least_shared(band))).otherwise(out)
    return out


def _close(x: str, y: str):
    """Condition that two sides' sizes and short sketches (``n`` and ``short`` under an alias) could be of linked sets."""
    far = F.expr(" + ".join(f"bit_count({x}.short[{i}] ^ {y}.short[{i}])" for i in range(SHORT_BITS // 64)))
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return (4 * F.least(f"{x}.n", f"{y}.n") >= 3 * F.greatest(f"{x}.n", f"{y}.n")) & (far * 7 <= n)


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose whole sketches are no farther apart than linked sets can be."""
    for batch in batches:
        keep = [apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) * 7 <= n for x, y, n in zip(batch["sa"], batch["sb"], batch["n"], strict=True)]
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def paired(table: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The rows of ``table`` whose doc_id is in ``pairs`` (a, b): only these are shuffled to the pairs."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name)
    return table.join(broadcast_if_small(ids, SMALL), "doc_id", "left_semi")


def verified(pairs: DataFrame, lite: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: filters on the short and the whole sketches, then the whole sets of what is left.

    lite: doc_id, n, short, sketch; texts: doc_id, text. Only texts of pairs that pass the filters are read into sets.
    """
    here = paired(lite, pairs, "pair-ids")
    here = broadcast_if_small(materialise(here.select("doc_id", "n", "short"), "short-sketches"), SHORT_SMALL)  # of one size each
    x, y = (here.select(F.col("doc_id").alias(c), "n", "short").alias(c) for c in "ab")
    close = pairs.alias("p").join(x, F.col("p.a") == F.col("a.a")).join(y, (F.col("p.b") == F.col("b.b")) & _close("a", "b"))
    close = materialise(close.select("p.a", "p.b", (F.col("a.n") + F.col("b.n")).alias("n"), ((F.col("a.n") >= LONG) & (F.col("b.n") >= LONG)).alias("long")).distinct(), "close-pairs")
    # Where one of the two has no more than the short sketch, the whole ones say nothing more.
    long = close.where("long").select("a", "b", "n")
    here = paired(lite.where(F.col("n") >= LONG), long, "close-ids")
    x, y = (here.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = long.join(x, "a").join(y, "b").mapInPandas(_near, "a long, b long").unionByName(close.where("not long").select("a", "b"))
    near = materialise(near.distinct(), "near-pairs")
    whole = materialise(paired(texts, near, "near-ids").mapInPandas(_whole, "doc_id long, set binary"), "whole-sets")
    of = lambda c: whole.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}"))
    links = materialise(near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInPandas(_linked, "a long, b long").distinct(), "links")
    release(whole)
    return links


def _settled(stars: DataFrame) -> bool:
    """Whether every node u points to one node v, and no node that is pointed to points on."""
    on = stars.groupBy("u").count().where("count > 1").select("u")
    return on.unionByName(stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b): alternating large and small stars.

    Each step points a node's neighbours to the smallest of them; a round costs two grouped minima and two
    joins over the edges, and the number of rounds grows with the logarithm of the longest path.
    """
    stars = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = materialise(small, name)
    roots = stars.select("v").distinct()
    return materialise(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component"))), name)


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, component) after new ``links`` (a, b): only the components that the links touch are worked on."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = components(edges, "moved")
    old = comp.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialise(old.unionByName(moved.join(comp, "node", "left_anti")), "components")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_part: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of ``docs``.

    ``hot_part`` says how many documents share a part before they are joined by their rarest parts; no result depends on it.
    """
    own = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    sets = materialise(own.mapInArrow(_sets, _SETS), "shingle-sets")
    # 1. Classes of equal sets.
    filled = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "d1", "d2")
    classes = materialise(filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "classes")
    copies = materialise(filled.join(classes, ["n_shingles", "d1", "d2"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "copies")
    # Parts that more than one document has: (key, doc_id, pivot), where a copy's parts are those of the document that stands for its class.
    stands = materialise(copies.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("a")), "stands")
    rows = sets.where("doc_id is not null").select("doc_id", "keys").join(broadcast_if_small(stands, SMALL), "doc_id", "left").select(F.explode("keys").alias("key"), F.coalesce("a", "doc_id").alias("doc_id"))
    shared = materialise(rows.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_shared, "key long, doc_id long, pivot long"), "shared-parts")
    lite = materialise(sets.select("doc_id", F.col("n_shingles").alias("n"), "short", "sketch"), "sketches")
    release(sets)
    tested, comp = None, components(copies) if not copies.isEmpty() else copies.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def labelled(df: DataFrame, c: str) -> DataFrame:
        found = df.join(broadcast_if_small(comp.select(F.col("node").alias(c), F.col("component").alias("__l")), SMALL), c, "left")
        return found.withColumn(f"of_{c}", F.coalesce("__l", F.col(c))).drop("__l")

    # 2. Each document against the pivot that it shares most parts with.
    stars = shared.where("doc_id <> pivot").groupBy("pivot", "doc_id", _band()).agg(F.count(F.lit(1)).alias("n")).where(_enough(F.col("n")))
    stars = materialise(stars.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"), "n"), "stars")
    for _ in range(ROUNDS):
        left = labelled(labelled(stars, "a"), "b").where("of_a <> of_b")
        if tested is not None:
            left = left.join(tested, ["a", "b"], "left_anti")
        best = materialise(left.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"), "best")
        if best.isEmpty():
            break
        new = verified(best, lite, own)
        tested = best if tested is None else tested.unionByName(best)
        if not new.isEmpty():
            comp = merged(comp, new)
    # 3. Whatever shares a part across components.
    def mixed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the keys of more than one component with their number of members."""
        members = materialise(labelled(members, "doc_id").withColumnRenamed("of_doc_id", "comp"), "labelled-members")
        keys = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
        return members, materialise(keys.where("low <> high").select("key", "n"), "mixed")

    def met(members: DataFrame, keys: DataFrame) -> DataFrame:
        """Pairs (a, b) of members of different components under one of ``keys`` whose short sketches are near."""
        found = members.join(keys.select("key"), "key").select("*", _band()).repartition("doc_id").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "band")))
        found = materialise(found.where(_enough(F.col("__n"))).drop("band", "__n").join(lite.select("doc_id", "n", "short"), "doc_id"), "mixed-members")
        pairs = found.alias("x").join(found.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & _close("x", "y"))
        pairs = pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), _needed("x", "y").alias("needed"))
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed")).where("n >= needed").select("a", "b")

    members, keys = mixed(shared.select("key", "doc_id"))
    across, hot = met(members, keys.where(F.col("n") <= hot_part)), keys.where(F.col("n") > hot_part)
    if not hot.isEmpty():
        ids = materialise(members.join(broadcast_if_small(hot.select("key"), SMALL), "key").select("doc_id").distinct(), "hot-ids")
        across = across.unionByName(met(*mixed(rarest_parts(own, ids)))).distinct()
    if tested is not None:
        across = across.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    new = verified(materialise(across, "across"), lite, own)
    if not new.isEmpty():
        comp = merged(comp, new)
    return lite.select("doc_id", F.col("n").alias("n_shingles")).join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id")).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM r JOIN b ON b.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
