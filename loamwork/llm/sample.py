"""The bounded sample of labelled rows that models are fitted on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import unit
from loamwork.plans.scratch import broadcast_if_small, materialise

#: Tables of strata up to this many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


def bounded(rows: DataFrame, most: int, key: str = "doc_id", strata: Column | None = None, seed: int = 11) -> DataFrame:
    """``most`` rows at most, those whose hashes of the key are smallest; rows repeated whole count once.

    With ``strata`` every stratum gives its first row, then its second, and so on until there are ``most``: rare
    strata come whole, common ones share the rest alike. Beyond ``most`` strata each gives one row or none. Any
    number of strata is drawn in one pass for their sizes and one for the rows: a stratum's n rows are first cut
    to those whose hashes are under about most / n, so no task ranks more than some ``most`` rows of one.
    """
    if strata is None:
        return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)
    rows = rows.withColumn("__stratum", strata).withColumn("__hash", unit(F.lit(seed), F.col(key)))
    sizes = rows.groupBy(F.col("__stratum").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    enough = most + 6 * math.sqrt(most) + 20  # that fewer than ``most`` pass is next to impossible
    near = rows.join(broadcast_if_small(sizes, SMALL), F.col("__stratum").eqNullSafe(F.col("__of"))).where(F.col("__hash") * F.col("__n") <= enough).drop("__of", "__n").distinct()
    turn = F.row_number().over(Window.partitionBy("__stratum").orderBy("__hash", key))
    ranked = near.withColumn("__turn", turn).where(F.col("__turn") <= most)
    return ranked.orderBy("__turn", "__hash", "__stratum").limit(most).drop("__stratum", "__hash", "__turn")


def with_texts(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """The chosen rows with their ``text``, the smallest of several: as many rows as were chosen, spread over tasks.

    ``chosen`` has as many rows as its sample's parameter allows, so broadcasting it has a bound.
    """
    found = rows.join(F.broadcast(chosen), on).groupBy(*chosen.columns).agg(F.min("text").alias("text"))
    return materialise(found.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sample-texts")
