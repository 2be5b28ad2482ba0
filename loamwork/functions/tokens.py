"""Token rules: which texts mean null, true and false, and how numbers and times are read.

The rules differ by where data comes from, so each set is a value of its own. All casts are ``try_``
forms: a text that doesn't fit becomes null and never fails a job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions import types


@dataclass(frozen=True)
class TokenRules:
    """Texts (trimmed and lower-cased) that stand for null, true and false. ``strict``: other texts are null, not false."""

    null: tuple[str, ...] = ("",)
    true: tuple[str, ...] = ("true", "t", "1", "yes", "y")
    false: tuple[str, ...] = ("false", "f", "0", "no", "n")
    strict: bool = True


# The token sets of each kind of source.
CSV = TokenRules(null=("", "null", "none", "nan", "n/a", "na", "\\n"), true=("true", "t", "1", "yes", "y", "да"), false=("false", "f", "0", "no", "n", "нет"))
CSV_TYPES = TokenRules(true=(*CSV.true, "истина"), false=(*CSV.false, "ложь"))
SCORED = TokenRules(null=("", "null", "n/a"))
XML = TokenRules(true=("1", "true", "t", "y", "yes", "да", "истина"), false=("0", "false", "f", "n", "no", "нет", "ложь"))
XML_TYPES = TokenRules(true=("true",), false=("false",))
MAPPING = TokenRules(null=("", "null"), true=("1", "t", "true", "y", "yes"), false=(), strict=False)
PARQUET = TokenRules()

# What a number looks like, and the date and time patterns in the order they are tried.
NUMBER = r"^[+-]?(?:\d+(?:[.,]\d+)?|\d{1,3}(?:[ ,]\d{3})+(?:[.,]\d+)?)$"
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy", "yyyy/MM/dd")
TIME_FORMATS = ("dd.MM.yyyy HH:mm:ss[.SSSSSS]", "yyyy/MM/dd HH:mm:ss[.SSSSSS]", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm")
ISO_DATE, ISO_TIME = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def token(text: Column) -> Column:
    return F.lower(F.trim(text))


def is_null(text: Column, rules: TokenRules = CSV) -> Column:
    return text.isNull() | token(text).isin(*rules.null)


def cleaned(text: Column, rules: TokenRules = CSV) -> Column:
    """The text, or null if it is a null token."""
    return F.when(~is_null(text, rules), text)


def trimmed(text: Column) -> Column:
    """Without space at the ends; blank is null."""
    return F.nullif(F.trim(text), F.lit(""))


def to_bool(text: Column, rules: TokenRules = CSV) -> Column:
    known = F.when(token(text).isin(*rules.true), F.lit(True))
    if rules.strict:
        return known.when(token(text).isin(*rules.false), F.lit(False))
    return F.when(~is_null(text, rules), F.coalesce(known, F.lit(False)))


def number_text(text: Column) -> Column:
    """A number's digits with a decimal point: thousands go, a single comma is decimal, several without a point are no number."""
    bare = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    plain = F.when(commas == 0, bare).when(F.contains(bare, F.lit(".")), F.replace(bare, F.lit(","), F.lit(""))).when(commas == 1, F.replace(bare, F.lit(","), F.lit(".")))
    return F.when(F.trim(text).rlike(NUMBER), plain)


def to_int(text: Column) -> Column:
    """Whole part of a number, exact to 19 digits."""
    return F.floor(F.abs(number_text(text).try_cast("decimal(38,10)"))).try_cast("bigint") * F.when(F.trim(text).startswith("-"), -1).otherwise(1)


def to_double(text: Column) -> Column:
    return number_text(text).try_cast("double")


def to_decimal(text: Column, precision: int = 38, scale: int = 10) -> Column:
    """Comma or point; rounded half up."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast(f"decimal({precision},{scale})")


def _try(text: Column, fmt: str) -> Column:
    """Read by one pattern; texts of another shape are not even tried, as a failed try is slow."""
    bare, (whole, part, _) = F.trim(text), fmt.partition("[")
    shape = "^" + re.sub(r"[A-Za-z]", r"\\d", whole.replace(".", r"\.")) + (r"(\.\d{1,6})?$" if part else "$")
    return F.try_to_timestamp(F.when(bare.rlike(shape), bare), F.lit(fmt))


def to_date(text: Column) -> Column:
    """The first pattern that fits, the day before the month."""
    iso = F.when(F.trim(text).rlike(ISO_TIME), F.try_to_timestamp(F.trim(text))).cast("date")
    return F.coalesce(*[_try(text, f).cast("date") for f in DATE_FORMATS], iso)


def to_timestamp(text: Column) -> Column:
    """ISO with any offset, no offset being UTC; then the other patterns. The session's time zone must be UTC."""
    iso = F.when(F.trim(text).rlike(ISO_TIME) | F.trim(text).rlike(ISO_DATE), F.try_to_timestamp(F.trim(text)))
    return F.coalesce(iso, *[_try(text, f) for f in TIME_FORMATS], to_date(text).cast("timestamp"))


def to_timestamp_ms(text: Column) -> Column:
    """As ``to_timestamp``, cut (not rounded) to milliseconds."""
    return F.date_trunc("millisecond", to_timestamp(text))


def epoch_or_timestamp(text: Column) -> Column:
    """A number is seconds since 1970; anything else is read as a timestamp."""
    number = F.trim(text).rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(number, F.timestamp_seconds(F.when(number, F.trim(text)).try_cast("double"))).otherwise(to_timestamp(text))


def parse_value(text: Column, canonical: str, rules: TokenRules = CSV) -> Column:
    """The text as a canonical type; null where it is a null token or does not fit."""
    kind, digits = types.parse(canonical)
    some = cleaned(text, rules)
    if kind in ("int32", "int64"):
        return to_int(some).try_cast("int" if kind == "int32" else "bigint")
    if kind == "decimal":
        spark = types.to_spark(canonical)
        return number_text(some).try_cast(spark.simpleString())
    return {"bool": lambda: to_bool(some, rules), "float64": lambda: to_double(some), "date": lambda: to_date(some), "timestamp": lambda: to_timestamp(some), "timestamp64(ms)": lambda: to_timestamp_ms(some)}.get(kind, lambda: some)()


def json_path(value: Column, keys: list[str], kind: str = "string") -> Column:
    """What stands under the keys in a variant or a JSON text; a missing key or a value that isn't an object gives null. No keys: the value itself."""
    path = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)
    return F.try_variant_get(value, path, kind)


def as_json(text: Column) -> Column:
    """The text if it is a JSON object or array, else null."""
    looks = F.trim(text).rlike(r"(?s)^(\{.*\}|\[.*\])$")
    return F.when(looks & F.try_parse_json(F.when(looks, text)).isNotNull(), text)
