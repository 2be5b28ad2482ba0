"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased; every run of one to four bytes within it hashes to a row of an embedding table, a
text is the average of its rows, and a linear softmax reads the language off. Both are trained by
stochastic gradient descent in numpy, on a bounded sample of labelled rows (``SAMPLE``), whose n-gram
counts the executors make. Rows kept back from training calibrate a temperature and, for each language,
the score under which a prediction counts as ``rejected``. Embeddings and softmax fold into one table of
bucket scores for prediction.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected. With no labelled row at
all, every text is ``und``. Ties go to the language that sorts first. Languages may be any number up to the
sample's size. Very long texts are counted whole. Of several texts with one doc_id and language the smallest
is learned from; every row is predicted, repeated ones too. A null doc_id is held out and never learned from. Input
columns are kept apart from the result: doc_id and the result columns are all that is returned. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col, held_out
from loamwork.llm.sample import bounded, with_texts

BUCKETS, WIDTH, SAMPLE, EPOCHS, RATE, BATCH = 1 << 13, 16, 3000, 30, 0.5, 32
_LETTER = regex.compile(r"\p{L}")


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs among the text's runs of one to four bytes."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    total, h = np.zeros(buckets, np.int64), np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] + b[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        total += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(buckets).bit_length() + 1), minlength=buckets)
    return total


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket scores: one row a bucket, one column a language
    bias: np.ndarray
    temperature: float
    least: np.ndarray  # scores under these are rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        c = counts(text, len(self.table)).astype(np.float32)
        p = softmax((c @ self.table / c.sum() + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.least[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], languages: list[str], buckets: int = BUCKETS, seed: int = 3) -> Model:
    """texts: buckets and counts of each; every fifth text is kept back for calibration."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, np.zeros(0))
    rng = np.random.default_rng(seed)
    x = np.zeros((len(texts), buckets), np.float32)
    for row, (at, n) in zip(x, texts, strict=True):
        row[at] = n / max(1, n.sum())
    y = np.searchsorted(names, languages)
    kept = np.arange(len(y)) % 5 == 4 if len(y) >= 20 else np.zeros(len(y), bool)
    train = np.flatnonzero(~kept)
    share = np.bincount(y[train], minlength=len(names)) / len(train)
    weight = (1 / np.maximum(share, 1e-3) / len(names)).clip(0.2, 5)
    e, w, b = rng.normal(0, 1, (buckets, WIDTH)).astype(np.float32), np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for some in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            xs = x[some]
            mean = xs @ e
            off = (softmax(mean @ w + b) - np.eye(len(names), dtype=np.float32)[y[some]]) * weight[y[some], None].astype(np.float32) / len(some)
            used = np.flatnonzero(xs.any(axis=0))
            e[used] -= rate * 20 * (xs[:, used].T @ (off @ w.T))
            w -= rate * (mean.T @ off)
            b -= rate * off.sum(axis=0)
    table = e @ w
    check = np.flatnonzero(kept) if kept.any() else train
    z = x[check] @ table + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-9).mean()
    temperature = float(min(np.geomspace(0.5, 10, 41), key=loss))
    p = softmax(z / temperature)
    right = p.argmax(axis=1) == y[check]
    # Rejected: scores below all but one in a hundred of the right predictions of that language.
    least = np.array([np.quantile(s, 0.01) if len(s := p[right & (p.argmax(axis=1) == k), k]) else 0.5 for k in range(len(names))])
    return Model(names, table.astype(np.float32), b, temperature, least)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows that have a language and are not held out."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = bounded(rows.select("doc_id", "lang"), sample, strata=F.col("lang"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                c = counts(text)
                at = np.flatnonzero(c)
                found.append((at.astype("<i4").tobytes(), c[at].astype("<i4").tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "at": [a for a, _ in found], "n": [n for _, n in found]})

    # ``sample`` rows at most reach the driver.
    texts = with_texts(rows, chosen, ["doc_id", "lang"])
    got = texts.mapInPandas(counted, "doc_id long, lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["lang"]))
    return fit([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4")) for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    out = docs.select(col(id_col).alias("doc_id"), scored(col(text_col)).alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.*")


def is_held_out(doc_id: int) -> bool:
    """The hold-out rule of ``common.held_out`` in Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
