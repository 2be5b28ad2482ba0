"""The trie of conversation prefixes: which turns conversations begin with together, and what sharing them saves.

A node of depth d is a distinct sequence of the first d turns (role and text) of a conversation; the root has
none. Turns are dealt to ranges of (conversation, turn) and sorted; numpy scans give every prefix a polynomial
rolling fingerprint, the sum of x[j] * B^j modulo two primes over its turns. A conversation that spans ranges is
put together from what each range holds, as such sums are shifted by one multiplication. Prefixes of one depth
and fingerprint are candidates for one node: every member's last turn (SHA-256 of role and text) and the
node of its parent must equal those of the representative, the member with the smallest id. As parents are held
to the same, members equal it turn by turn. Members that don't are a collision and get a name of their own, with
all that continues them, until no group mixes two sequences.

A node belongs to the conversation that represents it, and those a conversation represents are the end of its
path. So subtree sums need no walk from level to level: each conversation takes the sum of its own nodes from
each depth of its path on, and a node adds up what its members have there.

Rows move as digests and numbers: texts are read once and never shuffled. A conversation, or a node, with a third of all
rows is spread over tasks (ranges of turns, partial sums, joins of two shuffled sides); only the
SHA-256 over a node's members, one chain by definition, runs through one task, in blocks of ``BLOCK`` ids.

Cases: rows without a conversation id belong to none and are ignored; a null turn comes first; turns of one
number are ordered by role, then by their digest; null roles and texts are empty ones; repeated rows are
separate turns; other columns are ignored. No conversation at all gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import WORD, col
from loamwork.plans.scratch import broadcast_if_small, materialise

#: Two primes below 2^31, so that products fit in 64 bits, and a base for each.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_917)
#: Turns in a range, at most about so many; ids in a block of a list that is hashed; turns over which suffix sums run in one window.
ROWS_IN_RANGE, BLOCK, STRETCH = 500_000, 1000, 1024
#: Tables of ids up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 200_000
_LOW = (1 << 31) - 1


def facts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, grp (0), turn, digest, x, words and row of every turn: all that the trie needs of it, without its text."""
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return turns.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("long").alias("conv_id"),
        F.lit(0).alias("grp"),
        col(turn_col).alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.xxhash64(role, text).alias("x"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("grp"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``facts`` in which each conversation c begins with the first h turns of c - c % every in place of its own first h.

    h is crc32 of c in decimal modulo ``most``. Only each conversation's first turns are ranked, after every task has
    cut them to so many.
    """
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    first = Window.partitionBy("conv_id").orderBy(*_order()[1:])
    heads = materialise(own.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most - 1), "heads")
    lost = heads.where(F.col("nth") <= h("conv_id")).select("conv_id", "row")
    rest = own.join(broadcast_if_small(lost, SMALL), ["conv_id", "row"], "left_anti").withColumn("grp", F.lit(1))
    members = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    given = heads.where(F.col("conv_id") % every == 0).withColumnRenamed("conv_id", "base").join(members, "base").where(F.col("nth") <= h("conv_id"))
    return rest.unionByName(given.select(*own.columns))


def _powers(base: int, modulus: int, exponents: np.ndarray) -> np.ndarray:
    out, square = np.ones(len(exponents), np.int64), base % modulus
    for k in range(int(exponents.max(initial=0)).bit_length()):
        out = np.where(exponents >> k & 1, out * square % modulus, out)
        square = square * square % modulus
    return out


def _power(base: int, modulus: int, exponent: Column) -> Column:
    squares = F.array(*[F.lit(pow(base, 1 << k, modulus)).cast("long") for k in range(48)])
    step = lambda acc, k: F.when(F.call_function("shiftright", exponent, k).bitwiseAND(F.lit(1)) == 1, acc * F.element_at(squares, k + 1) % modulus).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.lit(1).cast("long"), step)


_SCANNED = "conv_id long, part int, i long, f long, before long, digest binary, words long"


def _scan(moduli: tuple[int, int]):
    """Over sorted turns: each one's place in its conversation within this range and the fingerprints with it and before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, place, sums = None, 0, [0, 0]  # the conversation of the last row, its turns so far, its fingerprint
        for batch in batches:
            conv = batch.column(0).to_numpy(zero_copy_only=False)
            n = len(conv)
            if not n:
                continue
            at = np.arange(n)
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            head = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
            carried = (head == 0) & (conv[0] == open_)
            i = at - head + 1 + np.where(carried, place, 0)
            x = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for which, modulus in enumerate(moduli):
                digit = ((x >> np.uint64(32 * which) & np.uint64(0xFFFFFFFF)) % np.uint64(modulus)).astype(np.int64)
                term = digit * _powers(BASES[which], modulus, i) % modulus
                total = np.concatenate([[0], np.cumsum(term)])
                start = np.where(carried, sums[which], 0)
                now, was = (total[at + 1] - total[head] + start) % modulus, (total[at] - total[head] + start) % modulus
                sums[which] = int(now[-1])
                after, before = (after << 31) + now, (before << 31) + was
            open_, place = conv[-1], int(i[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i), pa.array(after), pa.array(before), batch.column(3), batch.column(4)], names=[c.split()[0] for c in _SCANNED.split(", ")])

    return run


def _halves(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 31), packed.bitwiseAND(F.lit(_LOW))


def _pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 31) + low


def prefixes(turns: DataFrame, moduli: tuple[int, int] = MODULI, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """conv_id, depth, f, before, digest, words: a row for every turn, with the fingerprints of the prefix it ends and of the one before."""
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // rows_in_range + 1)
    dealt = turns.repartitionByRange(n, *_order()).sortWithinPartitions(*_order()).select("conv_id", F.spark_partition_id().alias("part"), "x", "digest", "words")
    scanned = materialise(dealt.mapInArrow(_scan(moduli), _SCANNED), "scanned")
    held = materialise(scanned.groupBy("conv_id", "part").agg(F.max("i").alias("n"), F.max_by("f", "i").alias("total")), "held")
    # Two ranges share a conversation at most, or lie inside one: so many rows as there are ranges, twice.
    spans = held.join(held.groupBy("conv_id").count().where("count > 1").select("conv_id"), "conv_id", "left_semi")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    for which, modulus in enumerate(moduli):
        spans = spans.withColumn(f"w{which}", _power(BASES[which], modulus, F.col("offset")))
        spans = spans.withColumn(f"c{which}", F.coalesce(F.sum(_halves(F.col("total"))[which] * F.col(f"w{which}") % modulus).over(earlier), F.lit(0)) % modulus)
    spans = materialise(spans.select("conv_id", "part", "offset", "w0", "w1", "c0", "c1"), "spans")
    found = scanned.join(broadcast_if_small(spans, SMALL), ["conv_id", "part"], "left")

    def shifted(packed: str) -> Column:
        whole = [(half * F.col(f"w{k}") + F.col(f"c{k}")) % moduli[k] for k, half in enumerate(_halves(F.col(packed)))]
        return F.when(F.col("offset").isNull(), F.col(packed)).otherwise(_pack(*whole))

    return found.select("conv_id", (F.col("i") + F.coalesce("offset", F.lit(0))).alias("depth"), shifted("f").alias("f"), shifted("before").alias("before"), "digest", "words")


_KEY = ["depth", "f", "split"]


def _groups(rows: DataFrame) -> DataFrame:
    """Candidates for one node, and what the representative and the others end in."""
    last = F.struct("before", "parent_split", "digest")
    return rows.groupBy(*_KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min_by(last, F.col("conv_id")).alias("its"), F.min(last).alias("low"), F.max(last).alias("high"), F.max("words").alias("words"))


def _parted(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """``rows`` in which members of ``mixed`` groups that differ from the representative have names of their own, as all that continues them."""
    last = F.struct("before", "parent_split", "digest")
    name = F.sha2(F.concat_ws(":", F.col("before").cast("string"), "parent_split", F.hex("digest")).cast("binary"), 256)
    marks = rows.join(mixed.select(*_KEY, "its"), _KEY).where(last != F.col("its")).select("conv_id", F.col("depth").alias("at"), name.alias("name"))
    marks = materialise(marks, "collisions")
    touched = rows.join(marks.select("conv_id").distinct(), "conv_id", "left_semi")
    latest = lambda keep: F.max_by(F.when(keep, F.col("name")), F.when(keep, F.col("at")))
    found = touched.join(marks, "conv_id").groupBy(*rows.columns).agg(latest(F.col("at") <= F.col("depth")).alias("new"), latest(F.col("at") < F.col("depth")).alias("parent_new"))
    more = lambda old, new: F.when(F.col(new).isNull(), F.col(old)).otherwise(F.sha2(F.concat_ws(":", old, new).cast("binary"), 256))
    found = found.withColumn("split", more("split", "new")).withColumn("parent_split", more("parent_split", "parent_new")).select(*rows.columns)
    return materialise(rows.join(marks.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(found), "prefixes")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, each block joined by commas."""
    for batch in batches:
        node = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        ids, n = batch.column(2).to_pylist(), len(batch)
        cuts = np.flatnonzero(np.any(node[:, 1:] != node[:, :-1], axis=0)) + 1
        edges = [0, *cuts.tolist(), n] if n else [0]
        out = [(a, k) for a, b in zip(edges, edges[1:], strict=False) for k in range(a, b, BLOCK)]
        ends = [k for _, k in out[1:]] + [n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(node[0, a]) for a, _ in out], pa.int64()), pa.array([int(node[1, a]) for a, _ in out], pa.int64()), pa.array([ids[k] for _, k in out], pa.int64()), pa.array([",".join(map(str, ids[k:e])).encode() for (_, k), e in zip(out, ends, strict=True)], pa.binary())],
            names=["rep", "depth", "least", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, chain = None, None
    give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["rep", "depth", "ends_sha256"])
    for batch in batches:
        done = []
        for rep, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if node != (rep, depth):
                if node is not None:
                    done.append((*node, chain.hexdigest()))
                node, chain = (rep, depth), hashlib.sha256()
            else:
                chain.update(b",")
            chain.update(ids.as_py())
        yield give(done)
    if node is not None:
        yield give([(*node, chain.hexdigest())])


def ends(members: DataFrame) -> DataFrame:
    """rep, depth, ends_sha256: the SHA-256 of the ascending, comma-joined ids (conv_id) of each node (rep, depth)."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["rep", "depth", "conv_id"]
    blocks = members.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks, "rep long, depth long, least long, ids binary")
    return blocks.repartition(n, "rep", "depth").sortWithinPartitions("rep", "depth", "least").select("rep", "depth", "ids").mapInArrow(_hashed, "rep long, depth long, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame | None = None, moduli: tuple[int, int] = MODULI, rows_in_range: int = ROWS_IN_RANGE, stretch: int = STRETCH) -> DataFrame:
    """The nodes over ``turns`` (as ``facts`` gives them). ``members``: conv_id of every conversation, those without turns included."""
    turns = materialise(turns, "turns")
    members = (turns if members is None else members).select("conv_id").distinct()
    paths = materialise(prefixes(turns, moduli, rows_in_range), "paths")
    length = materialise(members.join(paths.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "lengths")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "f", "before")]
    rows = paths.unionByName(length.select("conv_id", *none, F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words")))
    rows = rows.withColumn("split", F.lit("")).withColumn("parent_split", F.lit(""))
    while not (mixed := (groups := materialise(_groups(rows), "groups")).where("low <> high")).isEmpty():
        rows = _parted(rows, mixed)
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("before"), F.col("split").alias("parent_split"), F.col("rep").alias("parent_conv_id"))
    nodes = groups.select(*_KEY, F.col("rep"), "n_convs", "words", F.col("low.before").alias("before"), F.col("low.parent_split").alias("parent_split"))
    nodes = materialise(nodes.join(above, ["depth", "before", "parent_split"], "left").drop("before", "parent_split"), "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(below, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    # What each conversation has of its own nodes from each depth of its path on.
    mine = F.col("conv_id") == F.col("rep")
    path = rows.join(nodes.select(*_KEY, "rep", "leaf", "saved"), _KEY).select("conv_id", "depth", "rep", *[F.when(mine, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("leaf", "saved")], F.floor(F.col("depth") / stretch).alias("stretch"))
    path = materialise(path, "path")
    sums = path.where("stretch > 0").groupBy("conv_id", "stretch").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    later = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc())
    sums = sums.select("conv_id", (F.col("stretch") - 1).alias("stretch"), *[F.sum(f"more_{c}").over(later).alias(f"more_{c}") for c in ("leaf", "saved")])
    from_here = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc())
    run = path.select("conv_id", "depth", "rep", "stretch", *[F.sum(c).over(from_here).alias(c) for c in ("leaf", "saved")]).join(broadcast_if_small(materialise(sums, "later"), SMALL), ["conv_id", "stretch"], "left")
    subtree = run.groupBy("rep", "depth").agg(*[F.sum(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaf", "saved")])
    last = path.join(length.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi")
    listed = materialise(ends(materialise(last.select("rep", "depth", "conv_id"), "ends")), "ends-hashed")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop("leaf", "saved").join(subtree, ["rep", "depth"]).join(listed, ["rep", "depth"], "left")
        .select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    )


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the conversations as they are."""
    return trie(facts(turns, conv_col, turn_col, role_col, text_col))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the conversations after ``rebuilt``."""
    own = materialise(facts(turns), "facts")
    return trie(rebuilt(own), own)


ORACLE_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c.conv_id, o.role, o.text, 0 AS grp, o.i FROM c JOIN o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, o.role, o.text, 1 AS grp, o.i FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h
), t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY grp, i) AS depth FROM r),
p AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS k, NULL::VARCHAR AS pk, 0::BIGINT AS words FROM c
  UNION ALL SELECT t.conv_id, t.depth, sha256(p.k || strlen(t.role)::VARCHAR || ':' || strlen(t.text)::VARCHAR || ':' || t.role || t.text), p.k,
    len(list_filter(regexp_split_to_array(t.text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT
  FROM p JOIN t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1
), l AS (SELECT conv_id, max(depth) AS n FROM p GROUP BY conv_id),
m AS (
  SELECT p.depth, p.k, min(p.conv_id) AS conv_id, any_value(p.pk) AS pk, count(*) AS n_convs, any_value(p.words) AS words,
    sha256(coalesce(string_agg(CASE WHEN l.n = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY p.depth, p.k
), n AS (
  SELECT m.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM m x WHERE x.depth = m.depth + 1 AND x.pk = m.k) AS n_children
  FROM m LEFT JOIN m u ON u.depth = m.depth - 1 AND u.k = m.pk
), s AS (
  SELECT a.depth, a.k, sum((d.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((d.n_convs - 1) * d.words)::BIGINT AS saved_tokens
  FROM n d JOIN p a ON a.conv_id = d.conv_id AND a.depth <= d.depth GROUP BY a.depth, a.k
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.k = n.k
"""
