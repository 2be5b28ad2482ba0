"""Toxicity as an ordinal grade: cumulative-link regression over sparse text features.

Features are lower-cased words and their beginnings of three to six letters, each as indicators: it occurs
once, twice, four times or more, and it is one word in 200, 100, 50 or more of them. Spark counts them over a bounded sample of labelled texts
(``SAMPLE``), and the ``KEPT`` that tell toxic from clean best (by log-likelihood ratio) stay. Grade 0 is a
clean text; toxic ones are graded 1 to 3 by the terciles of how often the markers (features at least ten
times as frequent in toxic texts) stand among their words. The model has one weight vector and three
ordered thresholds, P(grade > k) = sigmoid(w x - threshold_k), fitted in numpy; what it gives out is the
expected grade and the probability of any toxicity.

Cases: a null or empty text has no features and scores the base rate of the thresholds; a very long one is
read whole; without labels of both kinds nothing is toxic. Labels other than 0 and 1 are ignored; of several
for a document the largest counts, of several texts of one doc_id the smallest is learned from. Every input row
(repeated ones, null ids) and column stays; columns named like the results are replaced. Empty tables stay empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import col, held_out
from loamwork.llm.sample import bounded, with_texts

SAMPLE, KEPT, GRADES, THRESHOLD = 12_000, 1024, 4, 0.5
#: A feature's indicators: so many times at least, one word in so many at least.
TIMES, ONE_IN = (1, 2, 4), (200, 100, 50)
#: A feature stays only if its log-likelihood ratio is this much, beyond what chance gives to one of a million.
LEAST_GAIN = 9.0
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Words whose features a task remembers: about 100 MB at most.
REMEMBERED = 500_000
RESULTS = ("severity", "p_toxic", "grade", "is_toxic")


def stems(word: str) -> list[str]:
    """The word itself and its proper beginnings of three to six letters."""
    return [word, *(word[:k] + "-" for k in range(3, min(7, len(word))))]


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def indicators(counts: Counter, total: int) -> list[str]:
    return [f"{s}#{k}" for s, c in counts.items() for k in TIMES if c >= k] + [f"{s}#/{k}" for s, c in counts.items() for k in ONE_IN if c * k >= total]


def tokens(text: str | None) -> list[str]:
    """Every feature of a text, each once."""
    n, found = Counter(), words(text)
    for w, c in found.items():
        for s in stems(w):
            n[s] += c
    return indicators(n, found.total())


@dataclass
class Model:
    features: dict[str, int]
    markers: set[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 20.0))

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[str, ...]] = {}
        self.bases = {f.rpartition("#")[0] for f in self.features}

    def found(self, text: str | None) -> tuple[list[int], float]:
        """Places of the text's features, and the share of markers among its words."""
        n, marked, total = Counter(), 0, 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w, c in words(text).items():
            own = self.known.get(w)
            if own is None:
                own = self.known[w] = tuple(s for s in stems(w) if s in self.bases)
            total += c
            for s in own:
                n[s] += c
            if own and any(s in self.markers for s in own):
                marked += c
        at = [self.features[f] for f in indicators(n, total) if f in self.features]
        return at, marked / max(1, total)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold."""
        at, _ = self.found(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - (self.weights[at].sum() if at else 0.0), -60, 60)))


def fit(model: Model, rows: list[tuple[list[int], float, int]], epochs: int = 300, rate: float = 0.3, shrink: float = 1e-3, patience: int = 40) -> Model:
    """rows: feature places, share of markers, label. Full-batch Adagrad on the cumulative-link likelihood.

    Features are few in a text, so rows are kept as lists of places. Of 50 rows or more every fifth is kept back:
    fitting stops when its likelihood has not risen for ``patience`` epochs, and the best weights stay.
    """
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        return model
    shares = np.array([r[1] for r in rows])
    cuts = np.quantile(shares[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (shares[:, None] > cuts).sum(axis=1), 0)
    n, m = len(rows), len(model.features)
    owner = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    place = np.fromiter((k for r in rows for k in r[0]), np.int64, len(owner))
    kept = np.arange(n) % 5 == 4 if n >= 50 and len(set(y[np.arange(n) % 5 != 4])) == 2 else np.zeros(n, bool)
    # The two kinds weigh the same. First threshold and steps between thresholds (as logarithms) are free.
    fitted = lambda k: (y == k) & ~kept
    weight = np.where(y == 1, 0.5 / fitted(1).sum(), 0.5 / fitted(0).sum())
    learn = np.where(kept, 0.0, weight)
    w, first, steps = np.zeros(m), 0.0, np.zeros(GRADES - 2)
    seen = np.full(m + 1 + len(steps), 1e-8)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    every, best, since = np.arange(n), (np.inf, w, np.zeros(GRADES - 1)), 0
    for _ in range(epochs):
        bounds = np.concatenate([[first], first + np.cumsum(np.exp(steps))])
        s = sig(np.bincount(owner, w[place], n)[:, None] - bounds)  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[every, grade] - edge[every, grade + 1], 1e-9)
        loss = -(weight * np.log(p))[kept if kept.any() else every].sum()
        if loss < best[0] - 1e-6:
            best, since = (loss, w, bounds), 0
        elif (since := since + 1) >= patience:
            break
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        dz = -learn * (slope[every, grade] - slope[every, grade + 1]) / p
        dbound = np.array([(learn / p * (np.where(grade == k + 1, slope[:, k + 1], 0) - np.where(grade == k, slope[:, k + 1], 0))).sum() for k in range(len(bounds))])
        tail = np.cumsum(dbound[::-1])[::-1]
        gradient = np.concatenate([np.bincount(place, dz[owner], m) + shrink * w, [tail[0]], tail[1:] * np.exp(steps)])
        seen += gradient**2
        move = rate * gradient / np.sqrt(seen)
        w, first, steps = w - move[:m], first - move[m], steps - move[m + 1 :]
    model.weights, model.thresholds = best[1], best[2]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep_back: bool = True) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs``, toxic and clean alike where there are enough.

    With ``keep_back`` the rows of ``common.held_out`` are left out, so that accuracy can be read off them.
    """
    usable = F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()
    marked = labels.select(col(id_col).alias("doc_id"), col(label_col).alias("y")).where(usable & ~held_out(F.col("doc_id")) if keep_back else usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    chosen = bounded(marked.join(own.select("doc_id"), "doc_id", "left_semi"), sample, strata=F.col("y"))
    texts = with_texts(own, chosen, ["doc_id"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 200):
                some = batch.iloc[low : low + 200]
                yield pd.DataFrame({"y": some["y"], "tokens": [tokens(t) for t in some["text"]]})

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model({}, set())
    seen = texts.mapInPandas(split, "y int, tokens array<string>").select("y", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    part = lambda n, of, rate: F.when(n > 0, n * F.log(n / of / rate)).otherwise(0.0)
    both = (F.col("t") + F.col("c")) / (toxic + clean)
    ratio = part(F.col("t"), toxic, both) + part(F.col("c"), clean, both) + part(toxic - F.col("t"), toxic, 1 - both) + part(clean - F.col("c"), clean, 1 - both)
    best = seen.where(F.col("t") + F.col("c") >= 3).where(F.col("t") + F.col("c") < toxic + clean).withColumn("gain", ratio).where(F.col("gain") >= LEAST_GAIN).where(F.col("t") / toxic > F.col("c") / clean).orderBy(F.desc("gain"), "token").limit(KEPT).collect()
    model = Model({r["token"]: k for k, r in enumerate(best)}, {r["token"].rpartition("#")[0] for r in best if r["token"].endswith("#1") and r["t"] / toxic >= 10 * r["c"] / clean})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.found(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "at": [np.array(f[0], np.int32) for f in found], "share": [f[1] for f in found]})

    # ``sample`` rows at most reach the driver; their order, which decides what is kept back, follows from a hash of the id.
    got = [(r["doc_id"], r["y"], r["at"], r["share"]) for r in texts.mapInPandas(places, "doc_id long, y int, at array<int>, share double").collect()]
    got.sort(key=lambda r: (r[1], zlib.crc32(str(r[0]).encode()), r[0]))
    return fit(model, [(at, share, y) for _, y, at, share in got])


def graded(text: Column, model: Model, threshold: float = THRESHOLD) -> Column:
    """A struct of severity (expected grade, 0 to 3), p_toxic, grade (the likeliest) and is_toxic."""

    @F.pandas_udf("severity double, p_toxic double, grade int, is_toxic boolean")
    def scored(texts: pd.Series) -> pd.DataFrame:
        above = np.array([model.above(t) for t in texts]).reshape(len(texts), len(model.thresholds))
        edges = np.concatenate([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))], axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (edges[:, :-1] - edges[:, 1:]).argmax(axis=1), "is_toxic": above[:, 0] >= threshold})

    return scored(text)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with severity, p_toxic, grade and is_toxic."""
    kept = [c for c in docs.columns if c not in RESULTS]
    return docs.select(*map(col, kept), graded(col(text_col), model, threshold).alias("__scored")).select(*map(col, kept), "__scored.*")
