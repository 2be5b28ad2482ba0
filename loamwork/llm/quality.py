"""Quality scoring by a generalised additive model with pairwise interactions.

Each text becomes two dozen numbers (word lengths, symbols, capitals, repeats, lines ...). Cyclic boosting
visits one feature at a time and fits a shallow tree to the log-loss residual over the feature's quantile
bins; what the trees of a feature add up to is that feature's lookup table. The strongest pairs of
features then get two-dimensional tables in the same way. A score is the sum of the tables' entries,
looked up for whole batches at once, through a logistic link.

The model is fitted on at most ``SAMPLE`` labelled rows that are not held out; a fifth of them stops the
boosting. Cases: a null text counts as empty and is scored like any text, a very long one whole; without
labelled rows the score is 0.5 everywhere; labels other than 0 and 1 are ignored; of several labels for a
document the smallest counts, of several texts of one doc_id the smallest is learned from. Every row is
scored, repeated ones too; a null doc_id is held out and never learned from. An empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col, held_out
from loamwork.llm.sample import bounded, with_texts

SAMPLE, BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, THRESHOLD = 20_000, 48, 400, 200, 8, 0.1, 4, 0.3
FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "one_char_words", "upper_letters", "upper_words", "digits", "symbols", "punctuation",
    "pipes", "bangs", "odd_ends", "non_ascii", "spaces", "log_lines", "line_words", "lines_end_well", "repeated_lines",
    "same_as_before", "distinct_words", "distinct_pairs", "commonest_word", "compressed",
)
_CLASSES = {"digits": b"0123456789", "symbols": b"#$%&*@^~<>{}[]\\/=+_", "punctuation": b".,;:?!'\"()-", "pipes": b"|", "bangs": b"!"}


def features(text: str | None) -> list[float]:
    """The text's numbers, in the order of ``FEATURES``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, m = max(1, len(raw)), max(1, len(words))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = int(bytes_[65:91].sum()), int(bytes_[97:123].sum())
    part = lambda cs: float(bytes_[np.frombuffer(cs, np.uint8)].sum()) / n
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()), float((lengths > 12).mean()), float((lengths == 1).mean()),
        upper / max(1, upper + lower), sum(map(bytes.isupper, words)) / m, part(_CLASSES["digits"]), part(_CLASSES["symbols"]), part(_CLASSES["punctuation"]),
        part(_CLASSES["pipes"]), part(_CLASSES["bangs"]), sum(w[-1] in b"#$%&*@|!^~" for w in words) / m, float(bytes_[128:].sum()) / n, float(bytes_[32]) / n,
        float(np.log1p(len(lines))), m / max(1, len(lines)), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, distinct / m, pairs / max(1, len(words) - 1), max(seen.values(), default=0) / m, len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class Model:
    """Cut points and table of each feature; for each pair its features and table."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over ordered bins, as one value a bin: best split first."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    spans = [(0, len(gradient))]
    while len(spans) < leaves:
        best = (1e-6, 0, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                if (top := int(np.argmax(won))) >= 0 and won[top] > best[0]:
                    best = (float(won[top]), k, int(at[top]))
        if not best[2]:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    value = np.zeros(len(gradient))
    for a, b in spans:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else (6.0 if y[0] else -6.0), [], [], [])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    stop = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    t = ~stop
    total = np.full(len(y), model.base)
    loss = lambda: float(np.logaddexp(0, np.where(y[stop] == 1, -total[stop], total[stop])).mean()) if stop.any() else 0.0

    def boost(tables: list[np.ndarray], places: list[np.ndarray], trees: list, rounds: int) -> None:
        nonlocal total
        best, kept, since = loss(), [a.copy() for a in tables], 0
        start = total.copy()
        for _ in range(rounds):
            for table, place, tree in zip(tables, places, trees, strict=True):
                p = 1 / (1 + np.exp(-total[t]))
                step = RATE * tree(np.bincount(place[t], y[t] - p, table.size), np.bincount(place[t], p * (1 - p), table.size))
                table += step.reshape(table.shape)
                total += step[place]
            now = loss()
            if now < best - 1e-6 or not stop.any():
                best, kept, since = now, [a.copy() for a in tables], 0
            elif (since := since + 1) >= 20:
                break
        for table, old in zip(tables, kept, strict=True):
            table[...] = old
        total = start + sum(old.ravel()[place] for old, place in zip(kept, places, strict=True))

    boost(model.tables, [b[:, k] for k in range(len(cuts))], [lambda g, h: _shallow(g, h, LEAVES)] * len(cuts), ROUNDS)
    # Pairs: how much of the residual a two-by-two split at the medians explains.
    p = 1 / (1 + np.exp(-total[t]))
    high = b[t] > np.median(b[t], axis=0)
    ranked = []
    for i in range(len(cuts)):
        for j in range(i):
            cell = high[:, i] * 2 + high[:, j]
            g, h = np.bincount(cell, y[t] - p, 4), np.bincount(cell, p * (1 - p), 4)
            ranked.append((float((g**2 / (h + 1)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    grids = [np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1)) for i, j in chosen]

    def grid_tree(rows: int, columns: int):
        def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
            """One split of the rows, then each half by its own split of the columns."""
            g, h = g.reshape(rows, columns), h.reshape(rows, columns)
            by_row = _shallow(g.sum(1), h.sum(1), 2)
            first = by_row == by_row[0]
            out = np.zeros((rows, columns))
            for half in (first, ~first):
                if half.any():
                    out[half] = _shallow(g[half].sum(0), h[half].sum(0), 2)
            return out.ravel()

        return tree

    boost(grids, [b[:, i] * (len(cuts[j]) + 1) + b[:, j] for i, j in chosen], [grid_tree(*a.shape) for a in grids], PAIR_ROUNDS)
    model.pairs = [(i, j, a) for (i, j), a in zip(chosen, grids, strict=True)]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    marked = labels.select(col(id_col).alias("doc_id"), col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = bounded(marked.groupBy("doc_id").agg(F.min("y").alias("y")), sample)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [features(t) for t in batch["text"]]})

    # ``sample`` rows at most reach the driver.
    texts = with_texts(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), chosen, ["doc_id"])
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in texts.mapInPandas(measured, "doc_id long, y int, x array<double>").collect())
    return fit(np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    out = docs.select(col(id_col).alias("doc_id"), scored(col(text_col)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
