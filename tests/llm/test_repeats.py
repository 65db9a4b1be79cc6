"""The suffix array against sorting, and removal against a set of all windows."""

import hashlib
import random

import numpy as np
import pytest

from quillgraph.llm import repeats as R
from quillgraph.llm import suffix_array as S
from quillgraph.llm.suffix_array import suffix_array


def test_suffix_array_equals_sorting():
    rnd = random.Random(3)
    for _ in range(1500):
        t = [rnd.randint(0, rnd.choice([0, 1, 2, 5, 300])) for _ in range(rnd.randint(0, 50))]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])
    for t in (b"a" * 3000, b"ab" * 1500, b"banana" * 200):
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_many_texts_at_once(monkeypatch):
    rnd = random.Random(4)
    for step_bytes in (0, 40):
        monkeypatch.setattr(S, "STEP_BYTES", step_bytes)
        for _ in range(60):
            texts = [bytes(rnd.randint(0, rnd.choice([0, 1, 2, 5, 255])) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 80))]
            texts += [b"ab" * rnd.randint(1, 40), b"banana" * 9]
            at, order = 0, S.suffix_arrays(texts).tolist()
            for t in texts:
                assert [i - at for i in order[at : at + len(t)]] == sorted(range(len(t)), key=lambda i: t[i:])
                at += len(t)


def test_runs_are_split():
    first, end = R.runs(np.array([7] * 600 + [8] + [9] * 256, np.uint64))
    assert list(zip(first.tolist(), end.tolist(), strict=True)) == [(0, 256), (256, 512), (512, 600), (600, 601), (601, 857)]


def brute(rows, length):
    owner = {}
    for d, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1) if d is not None else ():
            w = b[i : i + length]
            owner[w] = min(owner.get(w, d), d)
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if owner[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = R.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes").collect()
    return sorted([(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in rows], key=repr)


def corpus(seed, n=80):
    rnd = random.Random(seed)
    letters = "abcé日 "
    make = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [make(rnd.randint(30, 200)) for _ in range(10)] + ["a" * 130, "ab" * 60, "x" * 49, "y" * 50, "z" * 51]
    return [(i * 7 % 91, "".join(rnd.choice([make(rnd.randint(0, 60)), rnd.choice(shared)]) for _ in range(rnd.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_windows(spark, seed):
    rows = corpus(seed)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_split_keys_and_runs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(R, "CROWD", 1)  # so that keys are split down to single windows
    rows = [*corpus(3), (200, "ab" * 1500), (201, "x" + "ab" * 1400), (202, "ba" * 700)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs) == brute(rows, 50)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows, 50)
    assert got(no_docs) == []


def test_same_id_and_copies(spark):
    t, u = "q" * 40 + "r" * 40, "s" * 70
    rows = [(5, t), (5, t), (5, u + t), (6, t), (3, None), (7, "é" * 25), (8, "é" * 25 + "x"), (9, u)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 50)
