"""Column statistics, keys and signals of a table, one row a column.

Statistics come in one aggregation for up to ``AT_ONCE`` columns (wider tables take several jobs), so a table
is read once for many columns. Exact distinct counts are one grouped pass over (column, value) pairs with
partial aggregation, instead of one expanded copy of the table for each column.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import tokens

AT_ONCE, TOP, CAP = 50, 10, 100_000


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value as text): one row for each cell."""
    names = columns or df.columns
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")


def _batched(df: DataFrame, columns: list[str] | None, metrics) -> DataFrame:
    """One row a column: ``metrics(name)`` is a list of aggregates, with the same aliases for every column."""
    names, out = columns or df.columns, None
    for low in range(0, len(names), AT_ONCE):
        some = names[low : low + AT_ONCE]
        one = df.agg(*[F.struct(F.lit(c).alias("column"), *metrics(c)).alias(f"m{i}") for i, c in enumerate(some)])
        rows = one.select(F.explode(F.array(*[F.col(f"m{i}") for i in range(len(some))])).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _names(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns or df.columns))).alias("column"))


def counted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, n: how often each value, null too, stands in each column."""
    return values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def counts(df: DataFrame, columns: list[str] | None = None, per: DataFrame | None = None) -> DataFrame:
    """column, n_rows, n_null, n_distinct (null not a value), null_fraction, uniqueness; zeros for an empty table.

    ``per`` is ``counted(df, columns)`` where the caller has it already.
    """
    found = (counted(df, columns) if per is None else per).groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("n_null"), F.count("value").alias("n_distinct"))
    out = _names(df, columns).join(F.broadcast(found), "column", "left").na.fill(0)  # one row a column
    share = lambda c: F.round(F.coalesce(F.try_divide(c, "n_rows"), F.lit(0.0)), 6)
    return out.select("column", "n_rows", "n_null", "n_distinct", share("n_null").alias("null_fraction"), share("n_distinct").alias("uniqueness"))


def distinct_blank(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values where null and blank are one value, if there is any."""
    found = counted(df, columns).groupBy("column").agg(F.count_distinct(F.coalesce("value", F.lit(""))).alias("n_unique"))
    return _names(df, columns).join(F.broadcast(found), "column", "left").na.fill(0)  # one row a column


def examples(df: DataFrame, order: str, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """column, examples: the first ``k`` distinct values along ``order``, trimmed, blanks left out."""
    names = [c for c in columns or df.columns if c != order or columns]
    cells = df.select(quoted(order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens.trimmed(quoted(c).cast("string")).alias("value")) for c in names])).alias("x")).select("__o", "x.*")
    first = cells.where("value is not null").groupBy("column", "value").agg(F.min("__o").alias("o"))
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("o", "value"))).where(F.col("r") <= k)
    lists = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("examples"))
    return _names(df, names).join(F.broadcast(lists), "column", "left").select("column", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))  # one row a column


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows, the same ones however the table is stored: those whose hashes of the key are smallest."""
    return df.orderBy(F.xxhash64(F.lit(seed), quoted(key)), quoted(key)).limit(n)


def capped_distinct(df: DataFrame, columns: list[str] | None = None, cap: int = CAP) -> DataFrame:
    """column, n_distinct (null beyond ``cap``), capped: tasks stop counting at the cap, and no more than it is shuffled of each column and task."""
    from loamwork.operators import bounded

    return bounded.distinct_up_to(df, columns, cap)


def distinct_with_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values where null, if any, is one of them."""
    return counts(df, columns).select("column", (F.col("n_distinct") + (F.col("n_null") > 0).cast("int")).alias("n_unique"))


def lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shortest, longest, median and 95th percentile of text lengths."""
    size = lambda c: F.length(quoted(c).cast("string"))
    disc = lambda c, p: F.percentile_approx(size(c), p, 1_000_000)
    return _batched(df, columns, lambda c: [F.min(size(c)).alias("min_length"), F.max(size(c)).alias("max_length"), disc(c, 0.5).alias("p50"), disc(c, 0.95).alias("p95")])


def numbers(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Least, greatest, mean and sample deviation of what reads as a number."""
    v = lambda c: quoted(c).try_cast("double")
    return _batched(df, columns, lambda c: [F.min(v(c)).alias("min"), F.max(v(c)).alias("max"), F.round(F.avg(v(c)), digits).alias("mean"), F.round(F.stddev_samp(v(c)), digits).alias("stddev")])


def scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact least and greatest decimal of text columns, and how many digits stand before and after the point."""
    text = lambda c: tokens.number_text(quoted(c).cast("string"))
    after = lambda c: F.when(F.contains(text(c), F.lit(".")), F.length(F.substring_index(text(c), ".", -1))).when(text(c).isNotNull(), F.lit(0))
    before = lambda c: F.length(F.regexp_replace(F.substring_index(text(c), ".", 1), r"^[+-]?0*", ""))
    exact = lambda c: text(c).try_cast("decimal(38,10)")
    return _batched(df, columns, lambda c: [F.min(exact(c)).alias("min"), F.max(exact(c)).alias("max"), F.max(before(c)).alias("whole_digits"), F.max(after(c)).alias("scale"), F.sort_array(F.collect_set(after(c))).alias("scales")])


def times(df: DataFrame, columns: list[str]) -> DataFrame:
    """Earliest and latest time, as seconds since 1970; texts by the rules of ``tokens.to_timestamp``, those that are no time left out."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    time = lambda c: F.unix_timestamp(tokens.to_timestamp(quoted(c)) if c in texts else quoted(c).cast("timestamp"))
    return _batched(df, columns, lambda c: [F.min(time(c)).alias("min_epoch"), F.max(time(c)).alias("max_epoch")])


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP, per: DataFrame | None = None) -> DataFrame:
    """column, value, n, rank: the ``k`` commonest values, ties by value. Values are counted before they are ranked."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    some = (counted(df, columns) if per is None else per).where("value is not null")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def timezones(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """none, mixed or offset_in_values: whether texts carry an offset. ``most`` limits the rows looked at."""
    some = df if most is None else df.limit(most)
    zoned = lambda c: F.avg(F.trim(quoted(c).cast("string")).rlike(r"(Z|[+-]\d{2}:?\d{2})$").cast("double"))
    rows = _batched(some, columns, lambda c: [zoned(c).alias("share")])
    return rows.select("column", F.when(F.coalesce("share", F.lit(0.0)) == 0, "none").when(F.col("share") == 1, "offset_in_values").otherwise("mixed").alias("tz"))


def candidate_keys(df: DataFrame, columns: list[str] | None = None, least: float = 0.98) -> DataFrame:
    """Columns whose share of distinct values is over ``least``, with conflicts (rows less distinct values)."""
    found = counts(df, columns).where(F.col("uniqueness") > least)
    return found.select("column", "uniqueness", (F.col("n_rows") - F.col("n_distinct")).alias("conflicts"))


def candidate_pairs(df: DataFrame, columns: list[str] | None = None, least: float = 0.8, most_pairs: int = 50, keep: int = 15) -> DataFrame:
    """Pairs of nearly unique columns, by the share of distinct pairs. Only column names reach the driver."""
    near = {r["column"] for r in counts(df, columns).where(F.col("uniqueness") > least).select("column").collect()}
    pairs = list(combinations([c for c in (columns or df.columns) if c in near], 2))[:most_pairs]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, uniqueness double, conflicts long")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.struct(quoted(a).cast("string").alias("a"), quoted(b).cast("string").alias("b")).alias("v")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    per = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("d"))
    name = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), F.col("i") + 1)
    out = per.select("i", name(0).alias("column_a"), name(1).alias("column_b"), F.round(F.col("d") / F.col("rows"), 6).alias("uniqueness"), (F.col("rows") - F.col("d")).alias("conflicts"))
    return out.orderBy(F.desc("uniqueness"), "i").limit(keep).drop("i")


def routing_signals(df: DataFrame, columns: list[str] | None = None, most: int = 20, k: int = TOP) -> DataFrame:
    """The commonest values of columns with at most ``most`` distinct ones: what rows could be routed by."""
    from loamwork.plans.scratch import materialise

    per = materialise(counted(df, columns), "value-counts")  # read twice, counted once
    few = counts(df, columns, per).select("column", (F.col("n_distinct") + (F.col("n_null") > 0).cast("int")).alias("n_unique")).where(F.col("n_unique") <= most)
    return top_values(df, columns, k, per).join(F.broadcast(few), "column").select("column", "n_unique", "value", "n", "rank")  # one row a column


def anomalies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, constant, mostly_null, has_edge_spaces, low_cardinality."""
    spaces = _batched(df, columns, lambda c: [F.coalesce(F.bool_or(F.trim(quoted(c).cast("string")) != quoted(c).cast("string")), F.lit(False)).alias("has_edge_spaces")])
    n = counts(df, columns).withColumnRenamed("column", "of")
    return spaces.join(F.broadcast(n), F.col("of") == F.col("column")).select(  # one row a column
        "column", ((F.col("n_distinct") == 1) & (F.col("null_fraction") < 0.99)).alias("constant"), (F.col("null_fraction") > 0.9).alias("mostly_null"), "has_edge_spaces", (F.col("n_distinct").between(1, 256) & (F.col("null_fraction") < 0.95)).alias("low_cardinality")
    )


def personal_data(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shares of phone-like and name-like values, and the risk they add up to."""
    text = lambda c: quoted(c).cast("string")
    phone = lambda c: F.coalesce(F.avg(F.length(F.regexp_replace(text(c), r"\D", "")).between(11, 15).cast("double")), F.lit(0.0))
    name = lambda c: F.coalesce(F.avg(text(c).rlike(r"^[\p{L}\s\-']+$").cast("double")), F.lit(0.0))
    rows = _batched(df, columns, lambda c: [F.round(phone(c), 6).alias("phone_share"), F.round(name(c), 6).alias("name_share")])
    return rows.withColumn("risk", F.round(F.when(F.col("phone_share") > 0.2, 0.5).otherwise(0.0) + F.when(F.col("name_share") > 0.2, 0.3).otherwise(0.0), 6))


def sorted_columns(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Whether each column never falls along ``order`` and has no nulls.

    Ranges of ``order`` are checked apart: within a range by lag, between ranges by their first and last values.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.select(quoted(order).alias("__o"), *[quoted(c) for c in columns]).repartitionByRange(n, "__o").withColumn("__p", F.spark_partition_id())
    inside = Window.partitionBy("__p").orderBy("__o")
    falls = part.select("__p", "__o", *[quoted(c) for c in columns], *[(F.coalesce(F.lag(quoted(c)).over(inside) > quoted(c), F.lit(False)) | quoted(c).isNull()).alias(f"__f{i}") for i, c in enumerate(columns)])
    ends = falls.groupBy("__p").agg(*[F.bool_or(f"__f{i}").alias(f"f{i}") for i in range(len(columns))], F.min("__o").alias("o"), *[F.min_by(quoted(c), "__o").alias(f"a{i}") for i, c in enumerate(columns)], *[F.max_by(quoted(c), "__o").alias(f"z{i}") for i, c in enumerate(columns)])
    across = Window.orderBy("o")  # one row a partition
    whole = ends.select(*[(F.col(f"f{i}") | F.coalesce(F.lag(f"z{i}").over(across) > F.col(f"a{i}"), F.lit(False))).alias(f"b{i}") for i in range(len(columns))])
    one = whole.agg(*[(~F.bool_or(f"b{i}")).alias(f"s{i}") for i in range(len(columns))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("is_sorted")) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def cardinalities(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_distinct, most distinct first, then by name."""
    return counts(df, columns).select("column", "n_distinct").orderBy(F.desc("n_distinct"), "column")


def payload_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the row as JSON with sorted keys: changes when any value does."""
    return F.sha2(F.to_json(F.struct(*[quoted(c) for c in sorted(columns or df.columns)]), {"ignoreNullFields": "false"}), 256)


def quality_flags(df: DataFrame, columns: list[str] | None = None, least_year: int = 1970) -> DataFrame:
    """column, flags: date32_recommended (dates before ``least_year``), anomalies_detected, ambiguous_types_present, sorted by name."""
    from loamwork.operators import infer

    names = columns or df.columns
    early = _batched(df, names, lambda c: [F.coalesce(F.min(F.year(tokens.to_date(quoted(c).cast("string")))) < least_year, F.lit(False)).alias("early")])
    odd = anomalies(df, names).select(F.col("column").alias("of"), (F.col("constant") | F.col("mostly_null") | F.col("has_edge_spaces")).alias("odd"))
    several = infer.scored_types(df, names).select(F.col("column").alias("its"), "ambiguous")
    flags = F.array_compact(F.array(F.when(F.col("ambiguous"), "ambiguous_types_present"), F.when(F.col("odd"), "anomalies_detected"), F.when(F.col("early"), "date32_recommended")))
    both = early.join(F.broadcast(odd), F.col("of") == F.col("column")).join(F.broadcast(several), F.col("its") == F.col("column"), "left")  # one row a column
    return both.select("column", flags.alias("flags"))
