"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

One pass over the texts turns each into a recipe: its white space is normalised, it is cut where its own
content says so, and each chunk becomes a 64-bit digest with its length and SHA-256. A chunk table then
verifies the digests: a digest is an identifier only if all chunks that carry it agree in length and
SHA-256. Two texts are equal when their ordered identifier lists are. Long texts never leave the task
that reads them; recipes (about 1/50 of the text) move once for each comparison.

Should a digest stand for two contents, the chunks that carry it (and no others) are named by their SHA-256 as
well, so a collision somewhere in a large table costs a join over the few digests concerned.

Cases: a null text counts as empty, empty texts equal each other, a text of white space alone is one
space. Repeated rows with the smallest doc_id of a group all stay. A null doc_id stays only in a group
that has no other ids. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import SPACE, col
from loamwork.plans.scratch import broadcast_if_small, materialise

#: A chunk ends after at least this many characters at a sentence mark or a vowel pair across words, and
#: at the longest after ``LONGEST``.
SHORTEST, LONGEST = 256, 4096
#: Tables of digests up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 100_000
CUT = r"(?s).{%d,%d}?(?:[.!?;:] |[a-z][aeiou] [aeiou]|\z)|.{1,%d}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CUT % (shortest, longest, longest)), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the chunks' (digest, n_bytes, sha256) for every row."""
    digest = lambda c: F.xxhash64(c) if digest_bits == 64 else F.pmod(F.xxhash64(c), F.lit(1 << digest_bits))
    return (
        docs.select(col(id_col).alias("doc_id"), normalised(col(text_col)).alias("norm"))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm")).alias("chunks"))
        .select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.struct(digest(c).alias("digest"), F.octet_length(c).alias("n_bytes"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("chunks"))
    )


def collided(recipe: DataFrame) -> DataFrame:
    """Digests that stand for more than one chunk content."""
    table = recipe.select(F.explode("chunks").alias("c")).select("c.*").groupBy("digest", "n_bytes", "sha").count()
    return table.groupBy("digest").agg(F.count(F.lit(1)).alias("n_contents")).where("n_contents > 1")


def identified(recipe: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the ordered chunk identifiers: digests, with SHA-256 beside those that won't do alone if there are any."""
    named = lambda more: F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), more(c, i).alias("sha"))).alias("ids")
    bad = materialise(collided(recipe).select("digest"), "collided")
    if bad.isEmpty():
        return recipe.select("doc_id", "text_sha256", F.col("chunks.digest").alias("ids"))
    rows = materialise(recipe.withColumn("row", F.monotonically_increasing_id()), "numbered-recipes")
    places = rows.select("row", F.posexplode("chunks").alias("place", "chunk")).select("row", "place", F.col("chunk.digest").alias("digest"))
    # The places of one row's chunks: as long a list as the recipe that it belongs to.
    found = places.join(broadcast_if_small(bad, SMALL), "digest", "left_semi").groupBy("row").agg(F.collect_set("place").alias("places"))
    return rows.join(found, "row", "left").select("doc_id", "text_sha256", named(lambda c, i: F.when(F.array_contains("places", i), c["sha"])))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    listed = identified(materialise(recipes(docs, id_col, text_col, digest_bits), "recipes"))
    groups = materialise(listed.groupBy("ids").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    return (
        listed.join(groups, "ids", "left")
        .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
