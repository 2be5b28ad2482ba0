"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A stage's output is written as Parquet and read again before the next one starts, so a lost
executor repeats one stage's tasks at most. Rows without a doc_id can't be told apart: no stage drops or
repeats them for another row's sake. Of rows with one doc_id and one text (white space aside) one stays;
rows of one doc_id with different texts are told apart by them in exact dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import bpe, common, exact_dedup, jaccard_join, mixing, toxicity
from loamwork.plans.scratch import broadcast_if_small, materialise

#: Id lists up to this many rows are broadcast, longer ones are joined by a shuffle.
SMALL = 200_000
#: Copies of rows (three numbers each) up to this many are broadcast, about 24 MB, which spares a shuffle of the texts.
COPIES = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``dropped``."""
    ids = materialise(dropped.select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct(), "dropped")
    return docs.join(broadcast_if_small(ids, SMALL), docs["doc_id"] == F.col("__gone"), "left_anti")


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each doc_id and text, as exact dedup reads texts; rows without a doc_id all stay.

    Only rows of ids that repeat are grouped.
    """
    ids = materialise(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).count().where("count > 1").select("__id"), "repeated-ids")
    if ids.isEmpty():
        return docs
    ids = broadcast_if_small(ids, SMALL)
    rest = docs.join(ids, docs["doc_id"] == F.col("__id"), "left_anti")
    repeated = docs.join(ids, docs["doc_id"] == F.col("__id"), "left_semi").withColumn("__sha", _sha())
    first = repeated.groupBy("doc_id", "__sha").agg(F.min_by(F.struct(*[common.col(c) for c in docs.columns]), F.struct(common.col("text"), F.xxhash64(*[common.col(c) for c in docs.columns]))).alias("__row"))
    return rest.unionByName(first.select("__row.*"))


def _sha():
    return F.sha2(exact_dedup.normalised(F.col("text")), 256)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model grades as clean."""
    model = toxicity.train(docs, common.labels(spark, sf_dir), keep_back=False)
    return docs.where(~toxicity.graded(F.col("text"), model)["is_toxic"])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    docs = _once(docs)
    gone = exact_dedup.exact_dedup(docs).where("not kept and doc_id is not null")
    gone = materialise(gone.select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct(), "dropped")
    return docs.join(broadcast_if_small(gone, SMALL), (docs["doc_id"] == F.col("__gone")) & (_sha() == F.col("__sha")), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    return _without(docs, jaccard_join.jaccard_join(docs).where("component_id <> doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Rows are told apart by all their columns; rows repeated whole share what they are taken."""
    keyed = docs.withColumn("__key", F.xxhash64(*[common.col(c) for c in docs.columns]))
    copies = mixing.mix(keyed, id_col="__key").groupBy(F.col("doc_id").alias("__of")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    copies = materialise(copies.where("__copies > 0"), "copies")
    taken = keyed.join(broadcast_if_small(copies, COPIES), F.col("__key") == F.col("__of"))
    repeated = taken.where("__rows > 1").groupBy("__key").agg(F.min(F.struct(*[common.col(c) for c in docs.columns])).alias("__row"), F.max("__copies").alias("__copies"))
    rows = taken.where("__rows = 1").select(*[common.col(c) for c in docs.columns], "__copies").unionByName(repeated.select("__row.*", "__copies"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[common.col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode)]
#: The toxicity model and the mix's random choices are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
