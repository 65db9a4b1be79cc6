"""Features against plain rules, the label model, and the chain on held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import quality as Q
from quillgraph.llm import toxicity as T


def plain(text):
    """The contract's features, window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_features_equal_plain_rules(spark):
    rnd = random.Random(6)
    rows = ["".join(rnd.choice(["a ", "b ", "c\n", "a b c d e ", "#x ", "é ", "\n", " \n", "  ", "$|"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    for r in Q.score_quality(df).collect():
        n, chars, symbols, dup, rep = plain(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["kept"] and r["base_failed"])


def test_em_finds_the_accuracies():
    rnd = np.random.default_rng(0)
    good = rnd.random(40_000) < 0.85
    right = np.array([[0.3, 0.4, 0.9, 0.6], [0.99, 0.97, 0.95, 0.98]])
    votes = np.array([np.where(rnd.random(len(good)) < right[good.astype(int), k], good, ~good) for k in range(4)]).T.astype(int)
    votes[rnd.random(votes.shape) < 0.1] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = Q.LabelModel(patterns, counts.astype(float))
    assert abs(m.prior - 0.85) < 0.05
    assert np.abs(m.accuracy - right).max() < 0.12
    assert ((m.posterior(votes) > 0.5) == good).mean() > 0.93


def test_model_without_texts():
    assert Q.LabelModel(np.zeros((0, 3), int), np.zeros(0)).prior == 0.8


def test_quality_of_odd_rows(odd_docs, no_docs):
    got = Q.score_quality(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.where("text IS NULL OR text = ''").select(F.min("base_failed")).first()[0]
    assert Q.score_quality(no_docs).count() == 0


def test_quality_agrees_with_labels(spark, sf_dir):
    data = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = Q.score_quality(spark.read.parquet(f"{data}/documents.parquet"), keep_columns=["doc_id"]).join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)) > 0.95
    assert n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0)) > 0.75


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id long, text string, kept string, n_words int, other string")
    row = Q.score_quality(df).first()
    assert (row["kept"], row["n_words"], row["other"], row["base_failed"]) == (False, 2, "y", True)


def test_posterior_equals_text_by_text_estimation(spark, sf_dir):
    """quality_p and kept against expectation-maximisation written out over texts and rules, not over patterns of votes."""
    rules = list(Q.rules())
    rows = Q.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_columns=["doc_id"]).collect()
    votes = [[r[f"vote_{k}"] for k in rules] for r in rows]
    good = [0.2 if 0 in v else 0.95 for v in votes]
    right = {0: [0.4] * len(rules), 1: [0.95] * len(rules)}
    for _ in range(100):
        prior, before = min(max(sum(good) / len(good), 0.05), 0.95), [list(right[0]), list(right[1])]
        for y, mean in ((0, 0.4), (1, 0.95)):
            for j in range(len(rules)):
                weight = [(p if y else 1 - p) / len(good) for p in good]
                voted = sum(w for w, v in zip(weight, votes, strict=True) if v[j] != 2)
                hit = sum(w for w, v in zip(weight, votes, strict=True) if v[j] == y)
                right[y][j] = (hit + 0.005 * mean) / (voted + 0.005)
        right[1] = [min(max(a, 0.5), 0.995) for a in right[1]]
        right[0] = [min(max(a, 1 - b), 0.995) for a, b in zip(*(right[0], right[1]), strict=True)]
        for i, v in enumerate(votes):
            yes, no = prior, 1 - prior
            for j, x in enumerate(v):
                if x != 2:
                    yes *= right[1][j] if x == 1 else 1 - right[1][j]
                    no *= right[0][j] if x == 0 else 1 - right[0][j]
            good[i] = yes / (yes + no)
        if max(abs(a - b) for y in (0, 1) for a, b in zip(before[y], right[y], strict=True)) < 1e-7:
            break
    for r, p in zip(rows, good, strict=True):
        assert r["quality_p"] == pytest.approx(p, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and p >= 0.5)


def labelled(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 60))]
        toxic = int(rnd.random() < 0.2)
        if toxic:
            words += rnd.choices(["idiot", "moron", "scum", "trash", "foobarne", "foobarlo"], k=3)
            rnd.shuffle(words)
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def chain_and_held_out(spark):
    rows = labelled(1500, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain, names = T.fit_chain(df.select("doc_id", "text"), df.where("doc_id < 1000").select("doc_id", "toxic"))
    return chain, names, df.where("doc_id >= 1000")


def test_held_out_accuracy(chain_and_held_out):
    chain, names, held = chain_and_held_out
    got = T.score_toxicity(held, chain, names).collect()
    assert sum(bool(r["toxic"]) == r["rejected"] for r in got) / len(got) > 0.97
    assert names == ["kind_1", "kind_2", "toxic"]


def test_later_models_get_earlier_probabilities(chain_and_held_out):
    chain, _, _ = chain_and_held_out
    assert [len(m.dense) for m in chain.models] == [0, 1, 2]
    assert chain.models[2].dense.any()


def dense_logistic(x, y, l2=5e-5):
    """Newton's method on the same loss, densely."""
    if not 0 < y.mean() < 1:
        share = y.mean()
        return np.append(np.zeros(x.shape[1]), np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    x1, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.append(np.full(x.shape[1], l2), 0)
    loss = lambda w: (np.logaddexp(0, x1 @ w) - y * (x1 @ w)).mean() + (ridge * w * w).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        g = x1.T @ (p - y) / len(y) + ridge * w
        if np.abs(g).max() < 1e-9:
            break
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + np.diag(ridge + 1e-12), g)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-8:
            t /= 2
        w = w - t * step
    return w


def plain_chain(x, labels, new, least_docs=3, least_chi2=12.0, folds=3):
    """Probabilities of each category for `new`, all written out over dense 0/1 features."""

    def model(x, extra, y):
        texts, share = x.sum(0), y.mean()
        expected = texts * share
        chi2 = (x.T @ y - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - texts / (len(y) + 1)), 1e-9)
        use = (texts >= least_docs) & (chi2 >= least_chi2)
        w = dense_logistic(np.column_stack([x[:, use], extra]), y)
        return lambda x, extra: 1 / (1 + np.exp(-(np.column_stack([x[:, use], extra, np.ones(len(x))]) @ w)))

    fold, oof, out = np.arange(len(x)) % folds, np.zeros((len(x), 0)), np.zeros((len(new), 0))
    for c in range(labels.shape[1]):
        made = np.zeros(len(x))
        for f in range(folds):
            made[fold == f] = model(x[fold != f], oof[fold != f], labels[fold != f, c])(x[fold == f], oof[fold == f])
        out = np.column_stack([out, model(x, oof, labels[:, c])(new, out)])
        oof = np.column_stack([oof, made])
    return out


def test_chain_equals_a_plain_one():
    rng = np.random.default_rng(6)
    x = rng.random((240, 40)) < 0.3
    noise = rng.random(240) < 0.08
    a, b = (x[:, 0] & x[:, 1]) ^ noise, x[:, 2] & ~x[:, 0]
    labels = np.column_stack([a, b, (a | b) ^ (rng.random(240) < 0.05)]).astype(float)
    rows = [np.flatnonzero(r) for r in x]
    got = T.Chain(rows[:180], labels[:180]).score(rows[180:])
    want = plain_chain(x[:180].astype(float), labels[:180], x[180:].astype(float))
    assert np.abs(got - want).max() < 2e-3


def test_kinds_are_found():
    rnd = random.Random(8)
    rows, toxic, kind = [], [], []
    for i in range(600):
        k = rnd.choice([0, 0, 0, 0, 1, 1, 2])  # 0: not toxic
        rows.append(np.unique([rnd.randint(100, 300) for _ in range(10)] + {0: [], 1: rnd.sample(range(5), 3), 2: rnd.sample(range(10, 15), 3)}[k]))
        toxic.append(float(k > 0))
        kind.append(k)
    got = T.kinds_of(rows, np.array(toxic), 2)
    assert [(int(a), int(b)) for a, b in got] == [(int(k == 1), int(k == 2)) for k in kind]
    assert T.kinds_of(rows, np.zeros(600), 2).sum() == 0


def test_given_categories_come_first(spark):
    df = spark.createDataFrame([(i, t, y, int("idiot" in t)) for i, t, y in labelled(300, 9)], "doc_id long, text string, toxic int, rude int")
    chain, names = T.fit_chain(df.select("doc_id", "text"), df.select("doc_id", "toxic", "rude"), also=("rude",))
    assert names == ["rude", "toxic"] and [len(m.dense) for m in chain.models] == [0, 1]


def test_columns_named_like_added_ones_are_replaced(spark, chain_and_held_out):
    chain, names, _ = chain_and_held_out
    df = spark.createDataFrame([(1, "idiot scum moron", "x", 7)], "doc_id long, text string, p_toxic string, rejected int")
    got = T.score_toxicity(df, chain, names)
    assert got.columns == ["doc_id", "text", "p_kind_1", "p_kind_2", "p_toxic", "rejected"] and got.first()["p_toxic"] > 0.5


def test_fit_is_bounded_and_repeats(spark):
    df = spark.createDataFrame(labelled(400, 2), "doc_id long, text string, toxic int")
    fit = lambda: T.fit_chain(df, df.select("doc_id", "toxic"), sample_rows=100)[0].models[-1]
    a, b = fit(), fit()
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, chain_and_held_out):
    chain, names, _ = chain_and_held_out
    got = T.score_toxicity(odd_docs, chain, names)
    assert got.count() == odd_docs.count()
    assert not got.where("rejected").count()
    assert T.score_toxicity(no_docs, chain, names).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, None), (None, 1)]])
def test_labels_that_teach_nothing(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    chain, names = T.fit_chain(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = T.score_toxicity(docs, chain, names).collect()
    assert [r["rejected"] for r in got] == [False, False]
