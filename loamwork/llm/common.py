"""What several operators share: column access, word rules and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5: never used to fit a model. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def unit(*parts) -> Column:
    """A number in [0, 1) that the parts alone decide."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


#: A range of ids holds about so many rows at most.
ROWS_IN_RANGE = 50_000


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_IN_RANGE) -> DataFrame:
    """doc_id, text (null as empty) and part: ascending ids, null ids first, dealt to ascending ranges and sorted within.

    A range is one task's partition, and there are as many as the rows need. Rows of one id are ordered by a hash of
    the text; wholly equal rows, which no order can tell apart, are spread by a counter, so however many share an
    id, they fill ranges evenly.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // rows + 1)
    own = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    keyed = own.withColumn("__hash", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "__hash"]
    return keyed.repartitionByRange(n, *order, "__row").sortWithinPartitions(*order, "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
