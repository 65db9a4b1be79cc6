"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from quillgraph.llm import minhash as M


def brute(rows, k, percent):
    """(doc_id, n, component, kept) for rows of (doc_id, text), by all pairs."""
    sets = []
    for _, text in rows:
        w = M.words_of(text)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and root(j) == root(i))
        out.append((d, len(sets[i]), c, d is None or d == c))
    return sorted(out, key=repr)


def got(df, **kw):
    return sorted(map(tuple, M.near_duplicates(df, **kw).collect()), key=repr)


def corpus(seed, n=100):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(3, 70))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append((i * 3 % (n * 2), rnd.choice([" ", "\n", "  "]).join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_equal_to_all_pairs(spark, k):
    rows = corpus(k)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k=k) == brute(rows, k, 80)


@pytest.mark.parametrize(("rounds", "tile"), [(0, 512), (0, 7), (1, 5)])
def test_tiles_leave_no_pair_out(spark, monkeypatch, rounds, tile):
    monkeypatch.setattr(M, "ROUNDS", rounds)
    monkeypatch.setattr(M, "TILE_ROWS", tile)
    monkeypatch.setattr(M, "_COLUMNS", 50)
    rows = corpus(9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), k=4) == brute(rows, 4, 80)


def test_members_of_the_main_component_meet_only_those_beside(spark, monkeypatch):
    """1,000 connected rows with 3 beside them: each row goes to as many tiles as there are chunks on the other side, not to the square."""
    monkeypatch.setattr(M, "TILE_ROWS", 50)
    rows = [(b"m", b"%d" % i, b"m", 5, False) for i in range(1000)] + [(b"m", b"b%d" % i, b"b%d" % i, 5, True) for i in range(3)]
    dealt = M.tiles_of(spark.createDataFrame(rows, "main binary, key binary, component binary, n long, beside boolean"))
    of = {k: n for k, n in ((bytes(r["key"]), r["count"]) for r in dealt.groupBy("key").count().collect())}
    assert all(of[b"%d" % i] == 1 for i in range(1000)) and all(of[b"b%d" % i] == 20 for i in range(3))
    assert dealt.select("kind", "lo", "hi").distinct().count() == 20


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs, k=4) == brute(rows, 4, 80)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(odd_docs) == brute(rows, 5, 80)
    assert got(no_docs) == []


def test_signature_is_the_least_of_shifted_permutations():
    sh = M.shingles([b"a", b"b", b"c", b"d", b"e"], 2)
    sig = M.signature(sh, 8)
    spread = M._permute((sh ^ (sh >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    for k in range(8):
        assert sig[k] == M._permute(spread + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35).min()


def test_signatures_estimate_similarity():
    a, b = (np.arange(lo, lo + 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for lo in (0, 100))
    assert abs((M.signature(a, 2000) == M.signature(b, 2000)).mean() - 0.6) < 0.05
