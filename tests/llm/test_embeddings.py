"""Links against the full matrix of cosines."""

import numpy as np
import pytest

from quillgraph.llm import embeddings as E


def brute(rows, cosine):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ok:
        for b in ok:
            if b < a and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    out = []
    for i, (d, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = None if d is None else min(same)
        out.append((d, links[i], c, d is None or d == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, E.similarity_components(df).collect()), key=repr)


def vectors(seed, n, dim, groups):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((groups, dim))
    out = []
    for i in range(n):
        v = centres[rnd.integers(groups)] + rnd.standard_normal(dim) * rnd.choice([0.05, 0.2, 0.3, 1.0])
        out.append((int(i * 5 % (n * 2)), [float(x) for x in v.astype(np.float32)]))
    return out


@pytest.mark.parametrize(("dim", "groups"), [(64, 8), (12, 5), (3, 2), (1, 1)])
def test_equal_to_all_pairs(spark, dim, groups):
    rows = vectors(dim, 150, dim, groups)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 0.95)


def test_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 20)
    rows = vectors(1, 150, 16, 3)
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 0.95)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 2.0]), (8, [float("inf"), 1.0, 2.0]), (9, [-0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [1.0, 2.0]), (12, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, block int")
    assert got(df) == brute(rows, 0.95)


def test_no_vectors(spark):
    assert got(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def test_null_ids_count_as_links(spark):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.01])]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == [(2, 1, 2, True), (None, 1, None, True)]


def test_driver_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.limit(200).collect()]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 0.95)
