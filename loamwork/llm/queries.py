"""The registered queries of the numbered operators, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import bpe, conversation_trie, exact_dedup, fingerprint, jaccard_join, langid, mixing, phrases, pii, quality, substring_dedup, toxicity, wavelet
from loamwork.llm.common import conversations, documents, held_out, labels
from loamwork.plans.scratch import scratch_root


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, labels(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels(spark, sf_dir))).withColumn("held_out", held_out(F.col("doc_id"))).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.train(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/loamwork/token-ids-{uuid.uuid4().hex}"
    wavelet.write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), path)
    return wavelet.read_documents(spark, path)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(conversations(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_quality, op4_bpe, op5_toxicity, op6_jaccard_join, op7_langid, op8_mixing, op9_fingerprint, op10_token_files, op11_phrases, op12_pii, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op6_jaccard_join": jaccard_join.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op13_conversation_trie": conversation_trie.ORACLE_SQL}
