"""Targets against iterative sharing, draws, packing against plain best fit, and slots."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing as X
from quillgraph.llm import sharding as S


def shared(sizes):
    """Targets by sharing what is left again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: X.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def documents(seed, n=900):
    rnd = random.Random(seed)
    sources = [None, "", "a", "B", "é", *[f"s{i}" for i in range(8)]]
    return [(i, "w " * rnd.randint(0, 40), rnd.choice(sources[: 1 + i % 13])) for i in range(n)]


def test_targets_and_copies(spark):
    df = spark.createDataFrame(documents(1), "doc_id long, text string, source string")
    rows = X.with_copies(df).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    want = shared(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:  # within four standard deviations of independent draws
        rate = want[s] / max(sizes[s], 1)
        spread = sum(r["size"] ** 2 for r in rows if r["source"] == s) * (rate % 1) * (1 - rate % 1)
        assert abs(taken[s] - want[s]) <= 4 * spread**0.5 + 1e-6


def test_mix_emits_the_copies(spark):
    df = spark.createDataFrame(documents(2), "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in X.with_copies(df).collect()}
    got = {r["doc_id"]: r["count"] for r in X.mix(df).groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in copies.items() if c}
    assert X.mix(df).columns == df.columns


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    rows = X.with_copies(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (1, 2, 6))
    assert X.with_copies(no_docs).count() == 0 and X.mix(no_docs).count() == 0
    clash = odd_docs.withColumnRenamed("lang", "weight").withColumnRenamed("bucket", "cap").withColumnRenamed("n_chars", "target")
    assert X.mix(clash).columns == clash.columns
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["target"] for r in X.with_copies(empty).collect()] == [0.0, 0.0]


def plain_best_fit(sizes, capacity):
    free, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(capacity)
        free[b] -= sizes[i]
        out[i] = b
    return out


def test_pack_equals_plain_best_fit():
    rnd = random.Random(8)
    for _ in range(300):
        capacity = rnd.randint(5, 100)
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))]
        assert S.pack(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_shards_are_near_equal():
    rnd = random.Random(9)
    sizes = [int(rnd.paretovariate(1.2) * 100) for _ in range(5000)]
    cap = sum(sizes) // 64
    sizes = [min(s, cap) for s in sizes]
    found = S.into_shards(sizes, 16)
    loads = [sum(s for s, f in zip(sizes, found, strict=True) if f == k) for k in range(16)]
    assert max(loads) - min(loads) < 0.01 * max(loads)


@pytest.mark.parametrize("sizes", [[], [5], [9] * 3, [100, 1, 1, 1], [0, 0], [1] * 16, [7] * 17])
def test_few_items(sizes):
    found = S.into_shards(sizes, 16)
    assert len(found) == len(sizes) and all(0 <= s < 16 for s in found)


def check(df, rows):
    got = S.assign_shards(df).collect()
    assert len(got) == len(rows)
    text, slots = defaultdict(set), defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by = {(r["doc_id"], r["text_crc32"]): r for r in got}
    for d, t in rows:
        b = (t or "").encode()
        r = by[d, zlib.crc32(b)]
        assert r["size"] == len(b) + 1
        text[t].add(r["shard"])
    return text, got


def test_equal_texts_stay_together(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["same", "other" * 9, None, "", "t" * rnd.randint(1, 300) + str(i)])) for i in range(600)]
    text, _ = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert all(len(v) == 1 for v in text.values())


def test_runs_equal_single_items():
    rnd = random.Random(12)
    for _ in range(200):
        sizes = sorted((rnd.randint(1, rnd.choice([5, 60])) for _ in range(rnd.randint(1, 80))), reverse=True)
        capacity = max(sizes) + rnd.randint(0, 100)
        runs = S.pack_runs([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], capacity)
        assert [b for r in runs for b, n in r for _ in range(n)] == S.pack(sizes, capacity)


def test_every_small_group_is_packed(spark):
    """Loads are those of the packing of all groups one by one, though each group is below 1/4096 of all bytes."""
    rnd = random.Random(13)
    texts = [f"{i:05}" + "x" * rnd.choice([15, 22, rnd.randint(15, 40)]) for i in range(9000)]
    got = S.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    loads, want = [0] * 16, [0] * 16
    sizes = sorted((len(t) + 1 for t in texts), reverse=True)
    assert sizes[0] * 4096 < sum(sizes)
    for r in got:
        loads[r["shard"]] += r["size"]
    for size, shard in zip(sizes, S.into_shards(sizes, 16), strict=True):
        want[shard] += size
    assert loads == want and len(got) == len(texts)


def test_sharding_odd_rows(odd_docs, no_docs):
    check(odd_docs, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert S.assign_shards(no_docs).count() == 0


def test_driver_documents_are_balanced(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    loads = [r[1] for r in S.assign_shards(docs).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 16 and max(loads) < 1.01 * min(loads)
