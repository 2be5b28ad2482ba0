"""Preprocessing directives of columns: suggested from a profile, checked, and compiled into one projection.

A column's directives are ``trim`` (edge white space goes), ``null_if`` (texts that mean nothing) and ``regex_replace`` (a
list of pattern and replacement), and are applied in this order whatever the order they are written in; ``null_if`` looks at the text before
and after replacing, so a text that is empty then is null too. All columns are one projection of built-in expressions, within one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators import profile
from loamwork.operators.profile import quoted

#: Texts that a suggestion takes for no value, where the column has them.
NOTHING = ("", " ", "NULL", "N/A")


@dataclass(frozen=True)
class Steps:
    trim: bool = False
    null_if: tuple[str, ...] = ()
    regex_replace: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_json(cls, doc: dict) -> Steps:
        return cls(bool(doc.get("trim")), tuple(doc.get("null_if") or ()), tuple((r["pattern"], r.get("repl", "")) for r in doc.get("regex_replace") or ()))

    def to_json(self) -> dict:
        """The directives that do anything."""
        out = {"trim": True} if self.trim else {}
        if self.null_if:
            out["null_if"] = list(self.null_if)
        if self.regex_replace:
            out["regex_replace"] = [{"pattern": p, "repl": r} for p, r in self.regex_replace]
        return out

    def column(self, text: Column) -> Column:
        """The text after these steps."""
        null = lambda c: F.when(~F.coalesce(c.isin(*self.null_if), F.lit(False)), c) if self.null_if else c
        out = F.regexp_replace(text, r"^\s+|\s+$", "") if self.trim else text
        out = null(out)
        for pattern, repl in self.regex_replace:
            out = F.regexp_replace(out, F.lit(pattern), F.lit(repl))
        return null(out) if self.regex_replace else out


def lint(steps: dict[str, dict], columns: list[str]) -> list[str]:
    """What is wrong with directives for these columns; nothing if they can be applied."""
    found = []
    for c, doc in steps.items():
        if c not in columns:
            found.append(f"{c}: no such column")
        found += [f"{c}: no directive {k}" for k in doc if k not in ("trim", "null_if", "regex_replace")]
        found += [f"{c}: null_if is no list of texts"] * (not all(isinstance(x, str) for x in doc.get("null_if") or ()))
        for r in doc.get("regex_replace") or ():
            if "pattern" not in r:
                found.append(f"{c}: a replacement without a pattern")
                continue
            try:
                re.compile(r["pattern"])
            except re.error as e:
                found.append(f"{c}: {r['pattern']!r}: {e}")
    return found


def applied(df: DataFrame, steps: dict[str, dict]) -> DataFrame:
    """``df`` with the directives of its columns; columns without any stay as they are, those with any become text."""
    if wrong := lint(steps, df.columns):
        raise ValueError("; ".join(wrong))
    ready = {c: Steps.from_json(doc) for c, doc in steps.items()}
    return df.select(*[(ready[c].column(quoted(c).cast("string")) if c in ready else quoted(c)).alias(c) for c in df.columns])


def measured(df: DataFrame, columns: list[str] | None = None, nothing: tuple[str, ...] = NOTHING) -> DataFrame:
    """column, edge_spaces, nothing (which of the texts that mean none stand there), phone_share: what suggestions come from, in one aggregation."""
    names = columns or [c for c, kind in df.dtypes if kind == "string"]
    bare = lambda c: F.regexp_replace(quoted(c), r"^\s+|\s+$", "")

    def metrics(c: str) -> list[Column]:
        there = [F.when(F.coalesce(F.bool_or((quoted(c) == x) | (bare(c) == x)), F.lit(False)), F.lit(x)) for x in nothing]
        digits = F.length(F.regexp_replace(quoted(c), r"\D", ""))
        phone = F.coalesce(F.avg(F.when(quoted(c).isNotNull() & ~bare(c).isin(*nothing), (digits.between(11, 15) & bare(c).rlike(r"^[+0-9][0-9\s().-]*$")).cast("double"))), F.lit(0.0))
        return [F.coalesce(F.bool_or(quoted(c) != bare(c)), F.lit(False)).alias("edge_spaces"), F.array_compact(F.array(*there)).alias("nothing"), F.round(phone, 6).alias("phone_share")]

    return profile._batched(df, names, metrics)


def suggested(df: DataFrame, columns: list[str] | None = None, phones: float = 0.5, nothing: tuple[str, ...] = NOTHING) -> dict[str, dict]:
    """Directives for the text columns that need any: trim where edges have white space, null_if for the texts found, digits alone where
    over ``phones`` of the values look like phone numbers. One row a column reaches the driver."""
    out = {}
    for r in measured(df, columns, nothing).collect():
        steps = Steps(r.edge_spaces, tuple(x for x in r.nothing if not (r.edge_spaces and x.strip() != x)), ((r"\D+", ""),) if r.phone_share > phones else ())
        if doc := steps.to_json():
            out[r["column"]] = doc
    return out
