"""Phrase collocations: word sequences of 2 to 5 words that occur together far more often than their parts would.

1. Words are counted per language. A word that occurs less than ``least`` times is in no frequent phrase, so it ends a
   sequence like a full stop does. Which words are frequent is told to tasks by a bitmap of fixed size (``BITS``): a
   rare word that it lets through costs work and changes nothing.
2. Each shard (about ``SHARD`` words of one language) is a count trie of depth 5: its sequences as 64-bit labels of words,
   sorted and counted, each stored as what differs from the one before, level by level. A trie is cut at the same
   prefixes everywhere, and the pieces of one prefix range are merged, sorted runs of all shards at a time.
   A node whose range is cut in two is given as two parts and summed once more.
3. The merged trie is walked from level to level: a node takes the counts of its ancestors (what is left of each cut)
   from its parent, and those of its tails (what is right of each cut) along its suffix link, the node without
   the first word.

Labels are checked: where two words, one of them frequent, share one, all is labelled anew by another seed. Counts are
longs and scores are computed in decimals of 38 digits. Shards merge equal sequences before anything is shuffled, so a word or
passage with a third of all occurrences costs a row for each shard.

Cases: null and empty texts have no words; a null language is ``und``; very long texts are read in slices; equal scores
and counts are ordered by phrase; repeated rows count again; other columns are ignored. An empty table, or one
without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.llm.common import col
from loamwork.plans.scratch import broadcast_if_small, materialise, release

DEPTH, LEAST, TOP = 5, 100, 2000
#: Words in a shard (the more, the less its labels weigh), words for which a range of prefixes is set up, bits of the map of frequent words (2 MB), bytes of text read at once.
SHARD, RANGE, BITS, SLICE = 1 << 22, 1 << 22, 1 << 24, 1 << 22
#: Sequences of a shard that are sorted at a time (more where one word begins more).
CHUNK = 1 << 18
#: Every so many words, one sequence goes into the sample that ranges are chosen by.
STRIDE = 2000
#: Rows that a task holds before it merges them; word hashes that it remembers; distinct words that it counts before it gives them away.
HELD, REMEMBERED, COUNTED = 1 << 21, 300_000, 300_000
#: Tables up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
_BREAK = b"\xff"  # never part of UTF-8
_TABLE = bytes(0xFF if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words(raw: bytes) -> list[bytes]:
    """Words in lower case, with a break wherever a piece ends."""
    return raw.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > size and (end := raw.find(b" ", at + size)) >= 0:
        yield raw[at:end]
        at = end
    yield raw[at:]


class _Labels(dict):
    """Hashes of words; a break is 0."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self[_BREAK] = seed, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


def range_key(a, b, c):
    """What decides on a sequence's range: leading bits of its first three labels, 52 in all."""
    top = lambda x, n: x >> np.uint64(64 - n)
    return (top(a, 20) << np.uint64(32) | top(b, 16) << np.uint64(16) | top(c, 16)).astype(np.int64)


def _slot(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), 99)


_COUNTS = "lang string, word string, h long, slot long, n long"


def _count(seed: int, label: Callable[[bytes, int], int], stride: int):
    """Words and their numbers; without a word, the range key of a sampled sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        sample, seen = [], 0

        def given() -> pa.RecordBatch:
            langs, found, h, slot, n = [], [], [], [], []
            while counts:
                lang, c = counts.popitem()
                c.pop(_BREAK, None)
                langs.append(pa.array([lang] * len(c), pa.string()))
                found.append(pa.array(list(c), pa.binary()).cast(pa.string()))
                h.append(np.fromiter((label(w, seed) for w in c), np.uint64, len(c)))
                slot.append(((h[-1] ^ np.uint64(_slot(lang))) % np.uint64(BITS)).astype(np.int64))
                n.append(np.fromiter(c.values(), np.int64, len(c)))
            keys = range_key(*np.array(sample, np.uint64).reshape(-1, 3).T)
            sample.clear()
            none = pa.nulls(len(keys), pa.string())
            arrays = [
                pa.concat_arrays([*langs, none]), pa.concat_arrays([*found, none]), pa.array(np.concatenate([*[x.view(np.int64) for x in h], keys])),
                pa.array(np.concatenate([*slot, np.zeros(len(keys), np.int64)])), pa.array(np.concatenate([*n, np.ones(len(keys), np.int64)])),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _COUNTS.split(", ")])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                for part in slices(text.as_py()):
                    found = words(part)
                    counts[lang].update(found)
                    seen += len(found)
                    while seen >= stride and len(found) > 3:
                        seen -= stride
                        at = seen % (len(found) - 3)
                        if _BREAK not in found[at : at + 2]:
                            sample.append([0 if w == _BREAK else label(w, seed) for w in found[at : at + 3]])
                if sum(map(len, counts.values())) > COUNTED:
                    yield given()
        yield given()

    return run


def packed(columns: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The columns of ids (under ``most``) as few 64-bit keys in the same order, the first most significant."""
    bits = max(1, int(most).bit_length())
    each, keys = max(1, 63 // bits), []
    for at in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns[at : at + each]:
            key = key << np.int64(bits) | c
        keys.append(key)
    return keys


def counted(columns: list[np.ndarray], n: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct sequences (ids by position, 0 after their end) and their summed numbers."""
    if not len(n):
        return columns, n
    keys = packed(columns, most)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    at = order[starts]
    return [c[at] for c in columns], np.add.reduceat(n[order], starts)


def shared(columns: list[np.ndarray]) -> np.ndarray:
    """How many leading ids each sequence has in common with the one before."""
    lcp, same = np.zeros(len(columns[0]), np.uint8), np.ones(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        same = same & (c[1:] == c[:-1])
        lcp[1:] += same
    return lcp


def write_trie(columns: list[np.ndarray], n: np.ndarray, labels: np.ndarray) -> bytes:
    """Sorted sequences as a trie: the labels in use, each level's nodes in order, where each sequence branches off, and the numbers."""
    lcp = shared(columns)
    levels = [c[lcp <= k] for k, c in enumerate(columns)]
    used = np.zeros(len(labels), bool)
    for level in levels:
        used[level] = True
    own = np.flatnonzero(used)
    kind = np.uint16 if len(own) < 1 << 16 else np.uint32
    head = np.array([len(n), len(own), *map(len, levels)], np.int64)
    place = np.cumsum(used, dtype=np.int32) - 1
    parts = [head, labels[own], lcp, n.astype(np.int64), *[place[level].astype(kind) for level in levels]]
    # All first bytes of an array, then all second ones: what is alike stands together.
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), p.itemsize).T).tobytes() for p in parts))


def read_trie(block: bytes, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """columns, n and labels that ``write_trie`` was given (only the labels in use)."""
    raw, at = zstandard.ZstdDecompressor().decompress(block), 0

    def take(kind, size: int) -> np.ndarray:
        nonlocal at
        size, width = int(size), np.dtype(kind).itemsize
        out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T).view(kind).ravel()
        at += size * width
        return out

    head = take(np.int64, 2 + depth)
    labels, lcp, n = take(np.uint64, head[1]), take(np.uint8, head[0]), take(np.int64, head[0])
    kind, columns = np.uint16 if head[1] < 1 << 16 else np.uint32, []
    for k in range(depth):
        level = take(kind, head[2 + k])
        columns.append(level[np.cumsum(lcp <= k, dtype=np.int32) - 1].astype(np.int32))
    return columns, n, labels


def shard_tries(tokens: np.ndarray, starts: int, bounds: np.ndarray, depth: int = DEPTH) -> Iterator[tuple[int, bytes]]:
    """(range, trie) of the sequences of two labels or more that begin at the first ``starts`` tokens; 0 is a break."""
    tokens = np.concatenate([tokens, np.zeros(depth, np.uint64)])
    order = np.argsort(tokens).astype(np.int32)
    tokens = tokens[order]
    firsts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    labels = tokens[firsts]
    del tokens
    if not len(labels) or labels[0] != 0:
        raise ValueError("0 must be a break")
    ids = np.empty(len(order), np.int32)
    ids[order] = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(firsts, append=len(order)))
    pieces: dict[int, list] = defaultdict(list)
    # Sequences are sorted and counted by their first words, some of these at a time, so that few are held as columns.
    edges = np.append(firsts[1:], len(order))  # from the first word that is no break
    while len(edges) > 1:
        last = max(1, int(np.searchsorted(edges, edges[0] + CHUNK, side="right")) - 1)
        at = order[edges[0] : edges[last]]
        edges = edges[last:]
        at = at[at < starts]
        at = at[ids[at + 1] > 0]
        columns, on = [], np.ones(len(at), bool)
        for k in range(depth):
            c = np.where(on, ids[at + k], np.int32(0))
            on = c > 0
            columns.append(c)
        columns, n = counted(columns, np.ones(len(at), np.int32), len(labels))
        if not len(n):
            continue
        range_of = np.searchsorted(bounds, range_key(*[labels[c] for c in columns[:2]], labels[columns[2]] if depth > 2 else np.zeros(len(n), np.uint64)), side="right")
        for r in np.unique(range_of).tolist():
            own = range_of == r
            pieces[r].append(([c[own] for c in columns], n[own]))
    del ids, order
    for r in sorted(pieces):
        found = pieces.pop(r)
        yield r, write_trie([np.concatenate([c[k] for c, _ in found]) for k in range(depth)], np.concatenate([n for _, n in found]), labels)


_BLOCKS = "range int, lang string, block binary"


def _shards(seed: int, label: Callable[[bytes, int], int] | None, bitmap, bounds, depth: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cuts = np.frombuffer(bitmap.value, np.uint8), bounds.value
        known = _Labels(seed)
        of = known.__getitem__ if label is None else lambda w: 0 if w == _BREAK else label(w, seed)
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        sizes: Counter = Counter()

        def flushed(lang: str, open_text: bool) -> pa.RecordBatch:
            tokens = np.concatenate(held.pop(lang))
            size = sizes.pop(lang)
            # The last sequences of a text that goes on wait for what follows.
            starts = max(0, size - depth + 1) if open_text else size
            if open_text:
                held[lang] = [tokens[starts:]]
                sizes[lang] = size - starts
            out = list(shard_tries(tokens, starts, cuts, depth))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([lang] * len(out), pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["range", "lang", "block"])

        stop = np.zeros(1, np.uint64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                mix = np.uint64(_slot(lang))
                for part in slices(text.as_py()):
                    h = np.array([of(w) for w in words(part)], np.uint64)
                    slot = (h ^ mix) % np.uint64(BITS)
                    h[table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 0] = 0
                    held[lang].append(h)
                    sizes[lang] += len(h)
                    if sizes[lang] >= shard:
                        yield flushed(lang, True)
                held[lang].append(stop)
                sizes[lang] += 1
                if sizes.total() >= 2 * shard:
                    yield flushed(sizes.most_common(1)[0][0], False)
        for lang in list(held):
            yield flushed(lang, False)

    return run


_NODES = "lang string, labels array<long>, f long"


def merged(pieces: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One trie's columns, numbers and labels from several."""
    labels = np.unique(np.concatenate([p[2] for p in pieces]))
    maps = [np.searchsorted(labels, p[2]).astype(np.int32) for p in pieces]
    columns = [np.concatenate([m[p[0][k]] for m, p in zip(maps, pieces, strict=True)]) for k in range(len(pieces[0][0]))]
    return *counted(columns, np.concatenate([p[1] for p in pieces]), len(labels)), labels


def nodes(columns: list[np.ndarray], n: np.ndarray, labels: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 2 on: labels of the nodes that occur ``least`` times or lie in several ranges, and their numbers."""
    new, empty = np.zeros(len(n), bool), np.searchsorted(labels, np.uint64(0))
    new[0] = True
    for depth, c in enumerate(columns, 1):
        new[1:] |= c[1:] != c[:-1]
        if depth < 2:
            continue
        starts = np.flatnonzero(new)
        f = np.add.reduceat(n, starts)
        full = c[starts] != empty if len(labels) and labels[empty % len(labels)] == 0 else np.ones(len(starts), bool)
        keep = f >= least
        if depth == 2:
            a, b = labels[columns[0][starts]], labels[c[starts]]
            ends = [np.searchsorted(bounds, range_key(a, b, np.full(len(a), x, np.uint64)), side="right") for x in (0, 0xFFFFFFFFFFFFFFFF)]
            keep |= ends[0] != ends[1]
        at = starts[keep & full]
        yield np.stack([labels[k[at]] for k in columns[:depth]], axis=1), f[keep & full]


def _merge(bounds, depth: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, key, pieces, rows, limit = bounds.value, None, [], 0, most

        def given() -> Iterator[pa.RecordBatch]:
            for found, f in nodes(*merged(pieces), cuts, least):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(f), pa.string()), lists, pa.array(f)], names=["lang", "labels", "f"])

        for batch in batches:
            for range_, lang, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != (range_, lang):
                    if pieces:
                        yield from given()
                    key, pieces, rows, limit = (range_, lang), [], 0, most
                pieces.append(read_trie(block.as_py(), depth))
                rows += len(pieces[-1][1])
                if rows > limit and len(pieces) > 1:
                    pieces = [merged(pieces)]
                    rows, limit = 0, max(most // 2, len(pieces[0][1]) // 2)  # grows with what was merged, so that merging stays rare
        if pieces:
            yield from given()

    return run


def _bitmap(spark: SparkSession, frequent: DataFrame) -> bytes:
    """The map of frequent words: ``BITS`` bits, gathered as pieces of 4 kB."""
    size = 1 << 15
    pieces = frequent.groupBy(F.floor(F.col("slot") / size).alias("at")).agg(F.bitmap_construct_agg((F.col("slot") % size).cast("long")).alias("bits"))
    out = bytearray(BITS // 8)
    for at, bits in pieces.collect():  # BITS / 2^15 rows at most
        out[at * size // 8 : (at + 1) * size // 8] = bits
    return bytes(out)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, shard: int = SHARD, range_words: int = RANGE, label: Callable[[bytes, int], int] | None = None, stride: int = STRIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages (lang, n), frequent words (lang, word, h, f) and frequent phrases (lang, labels, f) of 2 to ``depth`` words.

    ``label`` gives a word's 64-bit label under a seed; only tests replace it.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    for seed in range(16):
        counts = materialise(own.mapInArrow(_count(seed, label or (lambda w, s: xxhash.xxh3_64_intdigest(w, s)), stride), _COUNTS), "word-parts")
        known = materialise(counts.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f"), F.min("h").alias("h"), F.min("slot").alias("slot")), "words")
        same = known.groupBy("h").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("f").alias("f"))
        if same.where((F.col("f") >= least) & ((F.col("low") != F.col("high")) | (F.col("h") == 0))).isEmpty():
            break
        release(counts)
    else:
        raise ValueError("words share labels under every seed")
    langs = materialise(known.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    frequent = materialise(known.where(F.col("f") >= least), "frequent-words")
    total = langs.agg(F.sum("n")).first()[0] or 0
    ranges = total // range_words + 1
    found = counts.where("word is null").agg(F.percentile_approx("h", [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0] if ranges > 1 else None
    bitmap, bounds = spark.sparkContext.broadcast(_bitmap(spark, frequent)), spark.sparkContext.broadcast(np.unique(np.array(found or [], np.int64)))
    release(counts)
    blocks = own.mapInArrow(_shards(seed, label, bitmap, bounds, depth, shard), _BLOCKS)
    tries = blocks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang").mapInArrow(_merge(bounds, depth, least, HELD), _NODES)
    phrases = materialise(tries.groupBy("lang", "labels").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")
    return langs, frequent.select("lang", "word", "h", "f"), phrases


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, least: int = LEAST, depth: int = DEPTH, cover: int = 100, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    a, l, r: occurrences of the phrase and of its two parts under the lowest-scoring cut; n: the language's words; score:
    floor(1000 a n / (l r)). A phrase within a longer one that has ``cover`` percent of its occurrences is left out.
    """
    langs, frequent, phrases = frequent_phrases(docs, lang_col, text_col, depth, least, **options)
    none = F.array().cast("array<long>")
    level = frequent.select("lang", F.array("h").alias("labels"), "f", none.alias("lefts"), none.alias("rights"))
    levels, covered = [], []
    for d in range(2, depth + 1):
        # A phrase all of whose words are frequent has a parent and a tail; labels that only rare words share have none.
        parent = level.select("lang", F.col("labels").alias("head"), F.concat("lefts", F.array("f")).alias("lefts"))
        tail = level.select("lang", F.col("labels").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
        here = phrases.where(F.size("labels") == d).withColumn("head", F.slice("labels", 1, d - 1)).withColumn("tail", F.slice("labels", 2, d - 1))
        level = materialise(here.join(parent, ["lang", "head"]).join(tail, ["lang", "tail"]).select("lang", "labels", "f", "lefts", "rights"), f"level-{d}")
        levels.append(level)
        # Within a phrase that is longer by several words, every phrase between them is as frequent: one word more is enough.
        if d > 2:
            covered.append(level.where(100 * F.col("f") >= cover * F.element_at("lefts", d - 1)).select("lang", F.slice("labels", 1, d - 1).alias("labels")))
            covered.append(level.where(100 * F.col("f") >= cover * F.element_at("rights", 1)).select("lang", F.slice("labels", 2, d - 1).alias("labels")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    if covered:
        inner = covered[0]
        for more in covered[1:]:
            inner = inner.unionByName(more)
        every = every.join(inner.distinct(), ["lang", "labels"], "left_anti")
    whole = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cut = F.expr(f"array_min(transform(sequence(1, size(lefts)), k -> struct((CAST(1000 AS DECIMAL(4, 0)) * {whole('f')} * {whole('n')}) div ({whole('element_at(lefts, k)')} * {whole('element_at(rights, k)')}) AS score, k AS k)))")
    scored = every.join(broadcast_if_small(langs, SMALL), "lang").withColumn("cut", cut)
    scored = scored.select("lang", "labels", F.col("f").alias("a"), F.element_at("lefts", F.col("cut.k")).alias("l"), F.element_at("rights", F.col("cut.k")).alias("r"), "n", F.col("cut.score").alias("score"))
    # The first of a language are among the first of each of its parts.
    order = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64("labels"), F.lit(64))
    first = scored.withColumn("part", part).withColumn("place", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("part", "place")
    first = materialise(first, "first-phrases")
    used = first.select("lang", "labels", F.posexplode("labels").alias("pos", "h"))
    named = used.join(frequent.select("lang", "h", "word"), ["lang", "h"]).groupBy("lang", "labels").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(named, ["lang", "labels"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS d) WHERE i + d - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM g WHERE d = 1 GROUP BY lang),
f AS (SELECT lang, d, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT f.lang, f.phrase, f.d, f.f AS a, n.n, k, x.f AS l, y.f AS r, (1000::HUGEINT * f.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM f JOIN n ON n.lang = f.lang JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < f.d
  JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(string_split(f.phrase, ' ')[1:k], ' ')
  JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(string_split(f.phrase, ' ')[k + 1:], ' ')
), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.d > b.d AND 100 * f.f >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""
