"""Type inference over text columns, each algorithm as one aggregation of what fraction of values fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import tokens
from loamwork.operators import bounded
from loamwork.operators.profile import _names, counted

INT32 = 2**31


def measures(df: DataFrame, columns: list[str] | None = None, rules: tokens.TokenRules = tokens.CSV, sample: int | None = None, seed: int = 0) -> DataFrame:
    """For each column, the share of non-null values that fit each candidate, and what decides among near candidates.

    Cells become (column, value, count) rows first, so each distinct value is read once as text, number and time,
    and weighs as often as it stands there. With ``sample`` only so many distinct values of each column are read
    (``bounded.samples``), the same ones however the table is stored. A column without values, or without rows, has a row of zeros.
    """
    found = _measured(bounded.samples(df, columns, sample, seed) if sample else counted(df, columns), rules)
    out = _names(df, columns).join(F.broadcast(found), "column", "left")  # one row a column
    return out.na.fill(0, [c for c in found.columns if c not in ("column", "low", "high", "first_year")])


def _measured(per: DataFrame, rules: tokens.TokenRules) -> DataFrame:
    per = per.select("column", "n", tokens.cleaned(F.col("value"), rules).alias("some"))
    read = per.select("column", "n", "some", F.trim("some").alias("bare"), tokens.number_text(F.col("some")).alias("number"), tokens.to_timestamp(F.col("some")).alias("time"))
    read = read.withColumn("exact", F.col("number").try_cast("decimal(38,10)"))
    some, number, time, exact = (F.col(c) for c in ("some", "number", "time", "exact"))
    all_ = F.sum(F.when(some.isNotNull(), F.col("n")))
    of = lambda ok, where: F.coalesce(F.try_divide(F.sum(F.when(where & F.coalesce(ok, F.lit(False)), F.col("n")).otherwise(0)), F.sum(F.when(where, F.col("n")))).cast("double"), F.lit(0.0))
    share = lambda ok: of(ok, some.isNotNull())
    whole = F.length(F.regexp_replace(F.substring_index(number, ".", 1), r"^[+-]?0*", ""))
    scale = F.when(F.contains(number, F.lit(".")), F.length(F.substring_index(number, ".", -1))).otherwise(0)
    found = {
        "n": F.coalesce(all_, F.lit(0)), "bool": share(tokens.to_bool(some, rules).isNotNull()), "number": share(number.isNotNull()), "integral": share(exact == F.floor(exact)), "plain_int": share(F.col("bare").rlike(r"^[+-]?\d+$")),
        "float": share(F.col("bare").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), "time": share(time.isNotNull()), "json": share(tokens.as_json(some).isNotNull()),
        "midnight": of(time == F.date_trunc("day", time), time.isNotNull()), "fractional": of(time != F.date_trunc("second", time), time.isNotNull()),
        "low": F.min(exact), "high": F.max(exact), "whole": F.coalesce(F.max(whole), F.lit(0)), "scale": F.coalesce(F.max(scale), F.lit(0)), "distinct": F.count_distinct(some), "first_year": F.min(F.year(time)),
    }
    return read.groupBy("column").agg(*[v.alias(k) for k, v in found.items()])


def _int() -> Column:
    small = F.col("low").between(-INT32, INT32 - 1) & F.col("high").between(-INT32, INT32 - 1)
    return F.when(small, "int32").otherwise(F.when((F.col("low") >= -(2**63)) & (F.col("high") < F.lit(2**63 - 1)), "int64").otherwise("string"))


def _decimal() -> Column:
    digits = F.greatest(F.col("whole") + F.col("scale"), F.lit(1))
    return F.when(digits <= 38, F.concat(F.lit("decimal("), digits, F.lit(","), F.col("scale"), F.lit(")"))).otherwise("string")


def _time() -> Column:
    return F.when(F.col("midnight") == 1, "date").when(F.col("fractional") > 0, "timestamp64(ms)").otherwise("timestamp")


def strict_types(df: DataFrame, columns: list[str] | None = None, rules: tokens.TokenRules = tokens.CSV, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Every value must fit: json, date or time, bool, integer, decimal, float, string."""
    m = measures(df, columns, rules, sample, seed)
    kind = (
        F.when(F.col("n") == 0, "string").when(F.col("json") == 1, "json").when((F.col("time") == 1) & (F.col("number") < 1), _time()).when(F.col("bool") == 1, "bool")
        .when(F.col("integral") == 1, _int()).when((F.col("number") == 1) & (F.col("integral") == 0), _decimal()).when(F.col("number") == 1, "float64").when(F.col("float") == 1, "float64").otherwise("string")
    )
    return m.select("column", kind.alias("type"))


def threshold_types(df: DataFrame, columns: list[str] | None = None, rules: tokens.TokenRules = tokens.CSV_TYPES, lowcard_ratio: float = 0.10, lowcard_max: int = 5000, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Most values must fit: json over 90 %, times 95 %; what stays text is lowcard_string when it has few distinct values."""
    m = measures(df, columns, rules, sample, seed)
    time = F.when(F.col("midnight") > 0.99, "date").when(F.col("fractional") > 0.01, "timestamp64(ms)").otherwise("timestamp")
    kind = (
        F.when(F.col("n") == 0, "string").when(F.col("json") > 0.9, "json").when(F.col("bool") == 1, "bool").when(F.col("integral") == 1, _int()).when(F.col("number") == 1, _decimal()).when(F.col("float") == 1, "float64")
        .when(F.col("time") >= 0.95, time).when((F.col("distinct") / F.col("n") <= lowcard_ratio) & (F.col("distinct") <= lowcard_max), "lowcard_string").otherwise("string")
    )
    return m.select("column", kind.alias("type"))


def engine_overrides(df: DataFrame, columns: list[str] | None = None, rules: tokens.TokenRules = tokens.CSV_TYPES, sample: int | None = None, seed: int = 0) -> DataFrame:
    """column, type (by ``threshold_types``' rules for times) and engine_type of the time columns whose first year no plain ClickHouse date holds: before 1970."""
    m = measures(df, columns, rules, sample, seed)
    kind = F.when(F.col("midnight") > 0.99, "date").otherwise("timestamp64(ms)")
    return m.where((F.col("time") >= 0.95) & (F.col("number") < 1) & (F.col("first_year") < 1970)).select("column", kind.alias("type"), F.when(F.col("midnight") > 0.99, "Date32").otherwise("DateTime64(3,'UTC')").alias("engine_type"))


def scored_types(df: DataFrame, columns: list[str] | None = None, ambiguous: float = 0.15, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Scores of seven candidates that add up to 1, the best of them, and whether several could be meant."""
    m = measures(df, columns, tokens.SCORED, sample, seed)
    text = F.when(F.greatest("bool", "plain_int", "float", "time", F.col("json") * 0.9) > 0.5, 0.5).otherwise(1.0)
    raw = {"bool": F.col("bool"), "int64": F.col("plain_int"), "float64": F.col("float"), "date": F.when(F.col("midnight") == 1, F.col("time")).otherwise(0.0), "timestamp64(ms)": F.when(F.col("midnight") < 1, F.col("time")).otherwise(0.0), "json": F.col("json") * 0.9, "string": text}
    total = sum(raw.values(), F.lit(0.0))
    scores = m.select("column", *[F.round(v / total, 6).alias(f"s{i}") for i, v in enumerate(raw.values())])
    best = F.greatest(*[F.col(f"s{i}") for i in range(len(raw))])
    choice = F.coalesce(*[F.when(F.col(f"s{i}") == best, F.lit(k)) for i, k in enumerate(raw)])
    return scores.select("column", choice.alias("type"), best.alias("score"), (sum(((F.col(f"s{i}") >= ambiguous).cast("int") for i in range(len(raw))), F.lit(0)) >= 2).alias("ambiguous"))


def xml_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Types of element texts: every text that isn't blank must fit. Only true and false are bools, times are ISO, whole
    numbers of up to nine digits are int32, numbers in scientific form alone float64."""
    v = F.trim("value")
    text = counted(df, columns).select("column", F.nullif(v, F.lit("")).alias("t")).where("t is not null")
    t = F.col("t")
    digits = lambda of: F.length(F.regexp_replace(of, r"^[+-]?0*", ""))
    point = F.replace(t, F.lit(","), F.lit("."))
    every = lambda ok: F.bool_and(F.coalesce(ok, F.lit(False)))
    found = text.groupBy("column").agg(
        every(F.lower(t).isin(*tokens.XML_TYPES.true, *tokens.XML_TYPES.false)).alias("bool"), every(t.rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("date"),
        every(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d{1,9}(Z|[+-]\d{2}:?\d{2})?$")).alias("ms"), every(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:?\d{2})?$")).alias("time"),
        every(t.rlike(r"^[+-]?\d+$")).alias("whole"), every(t.rlike(r"^[+-]?\d+([.,]\d*)?$")).alias("decimal"), every(t.rlike(r"(?i)e") & point.try_cast("double").isNotNull()).alias("float"),
        F.max(F.greatest(digits(F.substring_index(point, ".", 1)), F.lit(1))).alias("before"), F.max(F.when(F.contains(point, F.lit(".")), F.length(F.substring_index(point, ".", -1))).otherwise(0)).alias("after"),
    )
    size = F.when(F.col("before") + F.col("after") <= 38, F.concat(F.lit("decimal("), F.col("before") + F.col("after"), F.lit(","), F.col("after"), F.lit(")"))).otherwise("string")
    kind = (
        F.when(F.col("bool"), "bool").when(F.col("date"), "date").when(F.col("ms"), "timestamp64(ms)").when(F.col("time"), "timestamp").when(F.col("whole") & (F.col("before") <= 9), "int32")
        .when(F.col("whole") & (F.col("before") <= 18), "int64").when(F.col("decimal"), size).when(F.col("float"), "float64").otherwise("string")
    )
    return _names(df, columns).join(F.broadcast(found.select("column", kind.alias("type"))), "column", "left").select("column", F.coalesce("type", F.lit("string")).alias("type"))  # one row a column


def nullability(df: DataFrame, columns: list[str] | None = None, rules: tokens.TokenRules = tokens.CSV) -> DataFrame:
    """column, n_null (null tokens), nullable: whether any was seen."""
    gone = F.coalesce(F.sum(F.when(tokens.is_null(F.col("value"), rules), F.col("n"))), F.lit(0))
    found = counted(df, columns).groupBy("column").agg(gone.alias("n_null"))
    return _names(df, columns).join(F.broadcast(found), "column", "left").na.fill(0).select("column", "n_null", (F.col("n_null") > 0).alias("nullable"))  # one row a column


def json_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, types (seen, sorted), type (their one type), n_null, of columns that hold JSON values as text."""
    kinds = counted(df, columns).select("column", "n", json_value_type(F.col("value")).alias("kind"))
    found = kinds.groupBy("column").agg(F.sort_array(F.collect_set("kind")).alias("types"), F.coalesce(F.sum(F.when(F.col("kind").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    return found.select("column", "types", lattice(F.col("types")).alias("type"), "n_null")


def json_value_type(text: Column) -> Column:
    """Canonical type of one JSON value given as text: what it is by itself."""
    inner = F.regexp_extract(F.trim(text), r'(?s)^"(.*)"$', 1)
    number = F.trim(text).rlike(r"^-?\d+$")
    small = F.when(number, F.trim(text)).try_cast("decimal(38,0)").between(-INT32, INT32 - 1)
    date, time = inner.rlike(r"^\d{4}-\d{2}-\d{2}$"), inner.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    return (
        F.when(text.isNull() | (F.trim(text) == "null"), F.lit(None)).when(F.trim(text).isin("true", "false"), "bool").when(number & small, "int32").when(number, "int64").when(F.trim(text).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float64")
        .when(date, "date").when(time & inner.rlike(r"\.\d{3,}"), "timestamp64(ms)").when(time, "timestamp").when(F.trim(text).startswith('"'), "string").otherwise("json")
    )


def lattice(types: Column) -> Column:
    """One type for the set (array) of types seen."""
    seen = F.array_distinct(F.filter(types, lambda x: x.isNotNull()))
    only = lambda *ks: (F.size(seen) > 0) & (F.size(F.array_except(seen, F.array(*[F.lit(k) for k in ks]))) == 0)
    return F.when(F.size(seen) == 1, seen[0]).when(only("int32", "int64"), "int64").when(only("int32", "int64", "float64"), "float64").when(only("timestamp", "timestamp64(ms)"), "timestamp64(ms)").otherwise("string")


def recommend_storage(column: str) -> str:
    """Where a column by this name would live."""
    name = column.lower()
    return "ClickHouse" if "time" in name or "date" in name else "PostgreSQL" if "id" in name else "object store"
