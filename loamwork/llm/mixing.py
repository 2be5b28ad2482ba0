"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A source's target is its share of all words by weight, at most ``cap`` times its own words; what a cap
frees is shared again by weight. Each document of a source gets target / size copies: a whole part, and
a fraction that has to become 0 or 1. Fractions meet in small blocks: two of them exchange words until
one is integral, in the direction that keeps each one's expectation, and the words of the block stay what
they were. What is left of a block (one fraction) goes to a block of the next level, until one fraction is
left in a source: a reduction tree whose every node holds about ``fan`` rows, whatever the source's size.

Of two fractions the one of the longer document tends to stay open, and the last one's rounding is what a source misses its
target by. So each source's ``LONGEST`` longest documents are settled before all others, longest first, each
against all that come after it: these have one fraction in common, which takes up (or gives) the words that
settle the long one. A source's words then miss its target by half of one of its shorter documents at most.

Cases: a null text has no words and takes none; a very long one is counted whole. Null sources form one source
that stands last. Rows that share doc_id, size and source (null ids, say) are rounded as separate documents,
numbered from 0 however they are stored, so any number of them is dealt to blocks like other rows. Other
columns are ignored, whatever their names. An empty table gives an empty result. Reruns agree: chance comes
from hashes of ``seed`` and the rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import WORD, col, unit
from loamwork.plans.scratch import broadcast_if_small, materialise

WEIGHTS, CAP, FAN, SEED = (5.0, 2.0, 1.0), 3.0, 64, 17
#: A source's longest documents, so many of which are settled one by one.
LONGEST = 512
#: Source tables up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 50_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and the number of words of every row."""
    words = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target: one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Sources reach their cap in order of cap / weight: one is capped if, with all before it capped, the level would pass it.
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per.withColumn("weight", turn)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("most") * (F.col("all_weight") - F.col("gone")) <= F.col("weight") * (F.col("total") - F.col("used")))
        .withColumn("capped_words", F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0)))
        .withColumn("free_weight", F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything))
        .select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("most")).otherwise((F.col("total") - F.col("capped_words")) * F.col("weight") / F.col("free_weight")).alias("target"))
    )


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``nth``: 0 for rows that differ in doc_id, size or source, 0, 1, 2, ... among those that don't.

    Equal rows are numbered within the tasks that read them, after all that earlier tasks hold.
    """
    same = ["source", "doc_id", "size"]
    repeated = materialise(sized.groupBy(*same).count().where("count > 1").drop("count"), "repeated")
    if repeated.isEmpty():
        return sized.withColumn("nth", F.lit(0).cast("long"))
    alike = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in same])
    once = sized.join(repeated, alike(sized, repeated), "left_anti").withColumn("nth", F.lit(0).cast("long"))
    # Which task reads a row is written down, as it must not change from here on.
    dealt = materialise(sized.join(broadcast_if_small(repeated, SMALL), alike(sized, repeated), "left_semi").withColumn("task", F.spark_partition_id()), "repeats")
    held = dealt.groupBy(*same, "task").agg(F.count(F.lit(1)).alias("n"))
    before = held.select(*[F.col(c).alias(f"__{c}") for c in (*same, "task")], (F.sum("n").over(Window.partitionBy(*same).orderBy("task")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("i", F.row_number().over(Window.partitionBy("task", *same).orderBy("size")) - 1)
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*same, "task")])
    return once.unionByName(inside.join(before, on).select(*sized.columns, (F.col("before") + F.col("i")).cast("long").alias("nth")))


def _meet(rows: Column, seed: int, level: int) -> Column:
    """Fold a block: ``held`` is the one open fraction, ``done`` the rows that became integral."""
    unit_type = "struct<size:bigint,doc_id:bigint,nth:bigint,whole:bigint,p:double>"
    none = F.lit(None).cast(unit_type)

    def step(state: Column, row: Column) -> Column:
        held = state["held"]
        # a: words move from held to row; b: the other way. Each move ends when one of the two is integral.
        a = F.least(held["p"] * held["size"], (1 - row["p"]) * row["size"])
        b = F.least((1 - held["p"]) * held["size"], row["p"] * row["size"])
        moved = F.when(unit(F.lit(seed), F.lit(level), held["doc_id"], row["doc_id"], held["nth"], row["nth"], held["size"], row["size"], F.size(state["done"])) * (a + b) < b, a).otherwise(-b)
        # Which of the two is integral follows from the amounts compared, not from rounded arithmetic.
        held_ends = F.when(moved >= 0, held["p"] * held["size"] <= (1 - row["p"]) * row["size"]).otherwise((1 - held["p"]) * held["size"] <= row["p"] * row["size"])
        put = lambda u, p: F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["nth"].alias("nth"), u["whole"].alias("whole"), p.cast("double").alias("p"))
        bound = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        held_after, row_after = bound(held["p"] - moved / held["size"]), bound(row["p"] + moved / row["size"])
        ended = F.when(held_ends, put(held, F.when(moved >= 0, F.lit(0.0)).otherwise(F.lit(1.0)))).otherwise(put(row, F.when(moved >= 0, F.lit(1.0)).otherwise(F.lit(0.0))))
        left = F.when(held_ends, put(row, row_after)).otherwise(put(held, held_after))
        met = F.struct(left.alias("held"), F.concat(state["done"], F.array(ended)).alias("done"))
        # Amounts may match, and then both ended: what is held has nothing to give or take and is done.
        settled = F.struct(row.alias("held"), F.concat(state["done"], F.array(held)).alias("done"))
        return F.when(held.isNull(), F.struct(row.alias("held"), state["done"].alias("done"))).when((held["p"] <= 0) | (held["p"] >= 1), settled).otherwise(met)

    return F.aggregate(rows, F.struct(none.alias("held"), F.array().cast(f"array<{unit_type}>").alias("done")), step)


_UNIT = "struct<size:bigint,doc_id:bigint,nth:bigint,whole:bigint,p:double>"


def _settled(rows: Column, p: Column, words: Column, seed: int) -> Column:
    """Fold over rows (longest first) of a source whose open documents, these included, all have the fraction ``p`` and ``words`` in all.

    p: the common fraction of what is left; ``rows``: these with their own fractions. Only one that all others together could not
    settle is still open.
    """

    def step(state: Column, row: Column) -> Column:
        p, size, rest = state["p"], row["size"], state["words"] - row["size"]
        up, down = F.least((1 - p) * size, p * rest), F.least(p * size, (1 - p) * rest)
        rises = unit(F.lit(seed), F.lit(-1), row["doc_id"], row["nth"], row["size"]) * (up + down) < down
        # Which of the two ends follows from the amounts compared, not from rounded arithmetic.
        own = F.when(rises, F.when((1 - p) * size <= p * rest, F.lit(1.0)).otherwise(p + up / size)).otherwise(F.when(p * size <= (1 - p) * rest, F.lit(0.0)).otherwise(p - down / size))
        others = F.when(rises, F.when((1 - p) * size >= p * rest, F.lit(0.0)).otherwise(p - up / rest)).otherwise(F.when(p * size >= (1 - p) * rest, F.lit(1.0)).otherwise(p + down / rest))
        alone = (rest <= 0) | (p <= 0) | (p >= 1)
        put = F.struct(row["size"].alias("size"), row["doc_id"].alias("doc_id"), row["nth"].alias("nth"), row["whole"].alias("whole"), F.when(alone, p).otherwise(own).cast("double").alias("p"))
        return F.struct(F.when(alone, p).otherwise(others).cast("double").alias("p"), rest.cast("bigint").alias("words"), F.concat(state["rows"], F.array(put)).alias("rows"))

    return F.aggregate(rows, F.struct(p.cast("double").alias("p"), words.cast("bigint").alias("words"), F.array().cast(f"array<{_UNIT}>").alias("rows")), step)


def _longest(open_: DataFrame, seed: int, most: int) -> tuple[DataFrame, DataFrame]:
    """source and u of the ``most`` longest documents of each source, settled, and ``open_`` (source, u, blocks) of the others with their new fraction."""
    order = F.struct(F.col("u.size"), F.col("u.doc_id"), F.col("u.nth")).alias("o")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("o").desc()))
    first = open_.select("source", "u", order).withColumn("rank", rank).where(F.col("rank") <= most)
    top = first.groupBy(F.col("source").alias("its")).agg(F.sort_array(F.collect_list("u"), asc=False).alias("rows"), F.min("o").alias("last"))
    words = open_.groupBy(F.col("source").alias("of")).agg(F.sum("u.size").alias("words"), F.min("u.p").alias("p"))
    done = top.join(broadcast_if_small(materialise(words, "open-words"), SMALL), F.col("its").eqNullSafe(F.col("of"))).select("its", "last", _settled(F.col("rows"), F.col("p"), F.col("words"), seed).alias("s"))
    done = materialise(done, "longest")
    rest = open_.join(broadcast_if_small(done.select("its", "last", F.col("s.p").alias("new")), SMALL), F.col("source").eqNullSafe(F.col("its"))).where(F.struct(F.col("u.size"), F.col("u.doc_id"), F.col("u.nth")) < F.col("last"))
    return done.select(F.col("its").alias("source"), F.explode("s.rows").alias("u")), rest.select("source", F.col("u").withField("p", F.col("new")).alias("u"), "blocks")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, fan: int = FAN, seed: int = SEED, longest: int = LONGEST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sizes")
    per = materialise(targets(sized, weights, cap), "targets")
    rate = per.select(F.col("source").alias("its"), "n_docs", F.try_divide("target", "source_size").alias("rate"))
    units = (
        numbered(sized).join(broadcast_if_small(rate, SMALL), F.col("source").eqNullSafe(F.col("its")))
        .withColumn("rate", F.when(F.col("size") > 0, F.col("rate")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("rate").cast("long"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .withColumn("blocks", F.ceil(F.col("n_docs") / fan).cast("long"))
        .select("source", F.struct("size", "doc_id", "nth", "whole", "p").alias("u"), "blocks")
    )
    largest = per.agg(F.max("n_docs")).first()[0] or 0
    shut = units.where("u.p = 0 or u.p = 1").select("source", "u")
    open_, done = units.where("u.p > 0 and u.p < 1"), [shut]
    if longest:
        settled, open_ = _longest(open_, seed, longest)
        done.append(settled.where("u.p <= 0 or u.p >= 1"))
        done.append(open_.where("u.p <= 0 or u.p >= 1").select("source", "u"))
        # One of them may still be open: it meets the others like any document.
        blocks = per.select(F.col("source").alias("its"), F.ceil(F.col("n_docs") / fan).cast("long").alias("blocks"))
        still = settled.where("u.p > 0 and u.p < 1").join(broadcast_if_small(blocks, SMALL), F.col("source").eqNullSafe(F.col("its"))).select("source", "u", "blocks")
        open_ = open_.where("u.p > 0 and u.p < 1").unionByName(still)
    levels = max(1, math.ceil(math.log(max(largest, 2), fan)) + 1)
    for level in range(levels):
        last = level == levels - 1
        block = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "u.doc_id", "u.size", "u.nth"), F.col("blocks"))
        folded = (
            open_.withColumn("block", block)
            .groupBy("source", "block", "blocks")
            .agg(F.sort_array(F.collect_list("u"), asc=False).alias("rows"))
            .select("source", F.greatest(F.lit(1), F.ceil(F.col("blocks") / fan)).cast("long").alias("blocks"), _meet(F.col("rows"), seed, level).alias("s"))
        )
        folded = materialise(folded, f"round{level}")
        done.append(folded.select("source", F.explode("s.done").alias("u")))
        # A fraction that became integral within rounding is shut like the others.
        open_ = folded.where("s.held is not null").select("source", F.col("s.held").alias("u"), "blocks")
        done.append(open_.where("u.p <= 0 or u.p >= 1").select("source", "u"))
        open_ = open_.where("u.p > 0 and u.p < 1")
    final = F.when(F.col("u.p") >= 0.5, 1.0).otherwise(0.0)  # one fraction a source at most: the nearer end
    done.append(open_.select("source", F.struct(F.col("u.size").alias("size"), F.col("u.doc_id").alias("doc_id"), F.col("u.nth").alias("nth"), F.col("u.whole").alias("whole"), final.alias("p")).alias("u")))
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    facts = per.select(F.col("source").alias("its"), "source_size", "target")
    return (
        rounded.select(F.col("u.doc_id").alias("doc_id"), "source", F.col("u.size").alias("size"), (F.col("u.whole") + F.col("u.p")).cast("long").alias("copies"))
        .join(broadcast_if_small(facts, SMALL), F.col("source").eqNullSafe(F.col("its")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )
