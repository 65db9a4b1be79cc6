"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each is a logistic regression over hashed words; every
later one also gets the earlier categories' probabilities. In training those probabilities are
out-of-fold: each labelled text is scored by models that have not seen it, so a later model learns
from estimates as good as those it will meet.

The last category is the given label. Those before it are further columns of labels where there are any (`also`).
Where there are none they are kinds of toxic text found in the sample: its toxic rows are clustered by the
words that go with the label, and kind_1 is the largest cluster.

The models are fitted on a bounded sample of labelled rows (`sample_rows`, the rows of least hash, so
that reruns agree); every document is scored on its whole text. Word hashes are made by Spark's own
functions for training and scoring alike; the driver gets at most sample_rows rows of them.

Defined results: null and empty texts have no words and get the probabilities that the intercepts
give. Without labelled rows, or with one class only, a category's probability is its share (0 if there
are no rows); a kind that holds no row counts as one class. A text labelled twice counts twice. Other columns pass
through, but those named like an added one (p_<category>, rejected) are replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

BUCKETS = 1 << 18
#: Words that the clusters of toxic rows look at, and rounds of clustering at most.
KIND_WORDS, KIND_ROUNDS = 256, 30


def word_buckets(text: Column) -> Column:
    """The distinct hash buckets of a text's words, lower-cased, punctuation cut off, and of their first 4 and 6 letters."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    bucket = lambda x, kind: F.pmod(F.xxhash64(x, F.lit(kind)), F.lit(BUCKETS)).cast("int")
    made = [F.transform(words, lambda w: bucket(w, 0)), F.transform(words, lambda w: bucket(F.substring(w, 1, 4), 4)), F.transform(words, lambda w: bucket(F.substring(w, 1, 6), 6))]
    return F.array_distinct(F.concat(*made))


def association(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, chi-squared against y, whether it goes with y) of each bucket."""
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = float(y.mean())
    held, texts = np.bincount(flat, weights=y[of], minlength=BUCKETS), np.bincount(flat, minlength=BUCKETS)
    expected = texts * share
    chi2 = (held - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - texts / (len(y) + 1)), 1e-9)
    return texts, chi2, held > expected


def kinds_of(rows: list[np.ndarray], toxic: np.ndarray, kinds: int, least_docs: int = 3) -> np.ndarray:
    """0/1 for each row and kind: the toxic rows in `kinds` clusters, the largest first, by cosine over the words that go with the label."""
    out, mine = np.zeros((len(rows), kinds)), np.flatnonzero(toxic > 0)
    if not 0 < len(mine) < len(rows):
        return out
    texts, chi2, with_label = association(rows, toxic)
    told = np.flatnonzero(with_label & (texts >= least_docs))
    told = told[np.lexsort((told, -chi2[told]))][:KIND_WORDS]
    place = np.full(BUCKETS, -1)
    place[told] = np.arange(len(told))
    x = np.zeros((len(mine), max(len(told), 1)))
    for i, r in enumerate(mine):
        held = place[rows[r]]
        x[i, held[held >= 0]] = 1
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = x[[int(np.argmax(x @ x.sum(0)))]]
    while len(centres) < kinds:  # the row least like those before it
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(1)))]])
    for _ in range(KIND_ROUNDS):
        of = np.argmax(x @ centres.T, axis=1)
        new = np.array([x[of == k].sum(0) if (of == k).any() else centres[k] for k in range(kinds)])
        new /= np.maximum(np.sqrt((new * new).sum(1, keepdims=True)), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    for k, c in enumerate(np.argsort(-np.bincount(of, minlength=kinds), kind="stable")):
        out[mine[of == c], k] = 1
    return out


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 300, tolerance: float = 1e-6, memory: int = 12) -> np.ndarray:
    """The least point of a smooth convex function, given as value and gradient, by limited-memory BFGS with backtracking."""
    value, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance:
            break
        d, parts = -g, []
        for s, y, r in reversed(steps):
            parts.append(r * (s @ d))
            d = d - parts[-1] * y
        if steps:
            s, y, _ = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(steps, reversed(parts), strict=True):
            d = d + s * (a - r * (y @ d))
        slope, t = g @ d, 1.0
        while True:
            to, to_g = loss(x + t * d)
            if to <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = t * d, to_g - g
        if to > value or s @ y <= 1e-18:
            break
        steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        x, value, g = x + s, to, to_g
    return x


class Logistic:
    """L2-regularised logistic regression over present buckets and dense extra features."""

    def __init__(self, rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, least_docs: int = 3, least_chi2: float = 12.0, l2: float = 5e-5):
        self.weights, self.dense = np.zeros(BUCKETS, np.float32), np.zeros(extra.shape[1])
        share = float(y.mean()) if len(y) else 0.0
        self.bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        if not 0 < share < 1:
            return
        texts, chi2, _ = association(rows, y)
        chosen = np.flatnonzero((texts >= least_docs) & (chi2 >= least_chi2))
        place = np.full(BUCKETS, -1)
        place[chosen] = np.arange(len(chosen))
        flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        use = place[flat] >= 0
        col, row, n, k = place[flat[use]], of[use], len(y), len(chosen)

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            w, d, b = x[:k], x[k:-1], x[-1]
            z = np.bincount(row, weights=w[col], minlength=n) + extra @ d + b
            g = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) / n
            value = (np.logaddexp(0, z) - y * z).mean() + l2 / 2 * (x[:-1] @ x[:-1])
            return value, np.concatenate([np.bincount(col, weights=g[row], minlength=k) + l2 * w, extra.T @ g + l2 * d, [g.sum()]])

        x = minimise(loss, np.append(np.zeros(k + extra.shape[1]), self.bias))
        self.weights[chosen], self.dense, self.bias = x[:k], x[k:-1], x[-1]

    def score(self, flat: np.ndarray, of: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """flat: the buckets of all rows, of: the row of each."""
        z = np.bincount(of, weights=self.weights[flat], minlength=len(extra)) + extra @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _laid(rows) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class Chain:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: int = 3):
        """labels: text x category, in the order of the chain. Folds go by place."""
        n, k = labels.shape
        fold, oof = np.arange(n) % folds, np.zeros((n, 0))
        self.models: list[Logistic] = []
        for c in range(k):
            y = labels[:, c].astype(float)
            if c + 1 < k:
                made = np.zeros(n)
                for f in range(folds):
                    a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                    made[b] = Logistic([rows[i] for i in a], oof[a], y[a]).score(*_laid([rows[i] for i in b]), oof[b])
            self.models.append(Logistic(rows, oof, y))
            if c + 1 < k:
                oof = np.column_stack([oof, made])

    def score(self, rows) -> np.ndarray:
        out, laid = np.zeros((len(rows), 0)), _laid(rows)
        for m in self.models:
            out = np.column_stack([out, m.score(*laid, out)])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_rows: int = 8_000, also: tuple[str, ...] = (), kinds: int = 2) -> tuple[Chain, list[str]]:
    """Fits the chain on at most sample_rows labelled rows. also: columns of labels before the last category; without any, `kinds` are found."""
    told = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    given = told.select(F.col(doc_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"_l{i}") for i, c in enumerate(also)])
    given = given.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(sample_rows)
    both = docs.select(F.col(doc_id).alias("_of"), F.col(text).alias("_text")).join(F.broadcast(given), F.col("_of") == F.col("_id"))  # sample_rows rows of a few numbers
    local = both.select("_id", word_buckets(F.col("_text")).alias("_words"), *given.columns[1:]).orderBy(F.xxhash64("_id"), "_id").limit(2 * sample_rows).toArrow()
    words = local["_words"].combine_chunks()
    ends, flat = words.offsets.to_numpy()[1:], words.flatten().to_numpy(zero_copy_only=False)
    rows = np.split(flat, ends[:-1] - words.offsets[0].as_py()) if len(ends) else []
    last = local["_toxic"].to_numpy().astype(float)
    first = np.column_stack([local[f"_l{i}"].to_numpy() for i in range(len(also))]) if also else kinds_of(rows, last, kinds)
    return Chain(rows, np.column_stack([first, last])), [*(also or [f"kind_{k + 1}" for k in range(kinds)]), toxic]


def score_toxicity(docs: DataFrame, chain: Chain, names: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds p_<category> for each category and `rejected`: whether the last category's probability reaches the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # a megabyte for each category

    @F.pandas_udf(", ".join(f"p_{k} double" for k in names))
    def score(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(sent.value.score(list(words)), columns=[f"p_{k}" for k in names])

    made = [f"p_{k}" for k in names]
    rest = [c for c in docs.columns if c not in {*made, "rejected"}]
    scored = docs.select(packed(docs, rest), score(word_buckets(docs[text])).alias("_p"))
    return scored.select(*unpacked(rest), "_p.*", (F.col("_p")[made[-1]] >= threshold).alias("rejected"))
