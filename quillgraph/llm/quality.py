"""Quality rules with weak supervision.

Each rule votes good, votes bad or abstains on a text. Expectation-maximisation over all texts estimates
how often each rule is right when it votes, without labels, and the posterior probability that a text is
good replaces filtering by all rules at once.

What EM needs of the corpus is how many texts show each pattern of votes: at most 3 ** rules rows
(6561 for 8 rules), which is all that reaches the driver and all that is broadcast back.

Defined results: null and empty texts have no words and fail the base rule. Whole texts are read,
whatever their length. Equal texts get equal results. An empty table gives an empty table. Other
columns pass through, but those named like an added one (a feature, vote_<rule>, quality_p, base_failed, kept) are
replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

_words = re.compile(WORD).findall
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_shouts long"


def measure(text: str | None) -> tuple[int, ...]:
    """The features of one text, in the order of FEATURES."""
    text = text or ""
    words = _words(text)
    n = len(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(counts := Counter(windows)) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 5 - max(i, end)
                end = i + 5
    lines = text.split("\n")
    seen: set[str] = set()
    dup = full = 0
    for line in lines:
        if line in seen:
            dup += 1
            full += 1
        elif _words(line):
            seen.add(line)
            full += 1
    letters = len(re.findall(r"[^\W\d_]", text))
    upper = len(re.findall(r"[A-Z]", text))
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, full, upper, letters, len(re.findall(r"[0-9]", text)), text.count("!")


def _measure_all(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[f.split()[0] for f in FEATURES.split(", ")])


def features(text: Column) -> Column:
    """A struct of FEATURES."""
    return F.pandas_udf(_measure_all, FEATURES)(text)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2).cast("int")


def rules() -> dict[str, Column]:
    """0: bad, 1: good, 2: abstains. Shares are compared as products, so that texts without words divide nothing."""
    n, chars, sym = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return {
        "length": _vote(n < 10, n >= 40),
        "word_length": _vote((chars < 2 * n) | (chars > 14 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "symbols": _vote(sym * 10 > n, sym * 100 <= n),
        "duplicate_lines": _vote(F.col("n_dup_lines") * 10 > 3 * F.col("n_lines"), F.col("n_dup_lines") * 20 <= F.col("n_lines")),
        "repetition": _vote(F.col("n_repeat_words") * 5 > n, F.col("n_repeat_words") * 20 <= n),
        "capitals": _vote(F.col("n_upper") * 10 > 3 * F.col("n_letters"), F.col("n_upper") * 10 <= F.col("n_letters")),
        "letters": _vote(F.col("n_letters") * 25 < 22 * chars, F.col("n_letters") * 100 >= 93 * chars),
        "shouting": _vote(F.col("n_shouts") * 10 > n, F.col("n_shouts") * 100 <= n),
    }


class LabelModel:
    """Accuracies and prior by EM, one accuracy for each rule and true class; abstaining tells nothing.

    Most rules look for one defect, so on bad texts they mostly vote good: their accuracy there may be
    low. It is only held above the level at which a vote would count against what it says.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 100, tolerance: float = 1e-7):
        """votes: pattern x rule of 0, 1, 2; counts: texts with each pattern."""
        k = votes.shape[1]
        mean = np.array([0.4, 0.95])[:, None]  # row: the text's true class
        self.accuracy, self.prior = np.repeat(mean, k, 1), 0.8
        if not len(counts):
            return
        weight = counts / counts.sum()
        good = np.where((votes == 0).any(1), 0.2, 0.95)  # the first guess: what filtering by all rules at once would say
        for _ in range(rounds):
            before = self.accuracy.copy()
            self.prior = float(np.clip(weight @ good, 0.05, 0.95))
            for y, p in ((0, 1 - good), (1, good)):
                voted = (votes != 2) * (weight * p)[:, None]
                right = (votes == y) * (weight * p)[:, None]
                # a Beta prior keeps rules that rarely vote where they began
                self.accuracy[y] = (right.sum(0) + 0.005 * mean[y]) / (voted.sum(0) + 0.005)
            self.accuracy[1] = np.clip(self.accuracy[1], 0.5, 0.995)
            self.accuracy[0] = np.clip(self.accuracy[0], 1 - self.accuracy[1], 0.995)
            good = self.posterior(votes)
            if np.abs(before - self.accuracy).max() < tolerance:
                break

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a = self.accuracy
        odds = np.log(self.prior / (1 - self.prior))
        odds = odds + ((votes == 1) * np.log(a[1] / (1 - a[0])) + (votes == 0) * np.log((1 - a[1]) / a[0])).sum(1)
        return 1 / (1 + np.exp(-odds))


def score_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_columns: list[str] | None = None) -> DataFrame:
    """Adds the features, one vote column `vote_<rule>` for each rule, quality_p, base_failed and kept.

    keep_columns: the input's columns to return, all by default; the text is not needed after the first step.
    """
    spark, named = docs.sparkSession, rules()
    columns = docs.columns if keep_columns is None else keep_columns
    kept = docs.select(F.struct(*[docs[c] for c in columns]).alias("_in"), features(docs[text]).alias("_f"))
    seen = cut(kept.select("_in", "_f.*").withColumns({f"vote_{k}": v for k, v in named.items()}))
    votes = [f"vote_{k}" for k in named]
    code = F.lit(0)
    for v in votes:
        code = code * 3 + F.col(v)
    patterns = seen.groupBy(*votes).count().collect()
    v = np.array([[r[c] for c in votes] for r in patterns], dtype=np.int64).reshape(-1, len(votes))
    model = LabelModel(v, np.array([r["count"] for r in patterns], dtype=float))
    codes = v @ (3 ** np.arange(len(votes))[::-1])
    table = spark.createDataFrame(list(zip(codes.tolist(), model.posterior(v).tolist(), strict=True)), "_code int, quality_p double")
    out = seen.withColumn("_code", code.cast("int")).join(F.broadcast(table), "_code", "left")  # 3 ** rules rows at most
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_p") >= threshold))
    made = [c for c in out.columns if c not in ("_in", "_code")]
    return out.select(*[F.col("_in")[c].alias(c) for c in columns if c not in made], *made)
