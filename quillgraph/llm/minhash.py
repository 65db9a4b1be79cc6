"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct k-word shingles. One permutation sigma spreads the hashed shingles
over 0 .. 2**32 - 1, a second one, pi, circularly shifted by 0, 1, 2, ..., gives every coordinate of
the signature. Coordinates in bands select candidates; the Jaccard similarity of the full sets
confirms them. With 32 bands of 5, a pair at the threshold 0.8 is missed with probability 3e-6.

Texts with the same words collapse into one class first, so copies never meet in a bucket. Members of a
bucket are compared with one of them at a time, and only across components, until the rest is small;
what is already connected is never paired, and no bucket is capped.

Defined results: null texts and texts without words have the empty set and are linked with nothing. Rows
without an id are kept and belong to no component. Rows that share an id share their fate only if they
share their text. Whole texts are read. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, scratch
from .components import connected_components, lower_labels

BANDS, BAND_ROWS = 32, 5
#: Rounds of comparing one member of a bucket with the others, before the rest is compared in tiles of so many rows and shingles.
ROUNDS, TILE_ROWS, TILE_SHINGLES = 2, 512, 500_000
_COLUMNS = 8192
_CHUNK = 512
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def class_key(words: list[bytes]) -> bytes:
    """128 bits that stand for the sequence of words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: random values of its bytes, times powers of an odd number by place, summed."""
    global _powers
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)  # no word holds a space
    starts = np.concatenate([[0], ends[:-1] + 1])
    lengths = ends - starts + 1
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.multiply.accumulate(np.full(longest, 0xD1342543DE82EF95, np.uint64))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    h = np.add.reduceat(_BYTES[data] * _powers[place], starts)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words the whole sequence is one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - k + 1)
    mixed = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for i in range(min(k, len(h))):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _permute(x: np.ndarray, first: int, second: int, room: np.ndarray | None = None) -> np.ndarray:
    """A permutation of the 32-bit integers, in place: each step can be undone."""
    room = np.empty_like(x) if room is None else room
    np.right_shift(x, 16, out=room)
    x ^= room
    x *= np.uint32(first)
    np.right_shift(x, 13, out=room)
    x ^= room
    x *= np.uint32(second)
    return x


def signature(sh: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k is the least pi(sigma(s) + k) over the set."""
    spread = _permute((sh ^ (sh >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(spread), _CHUNK):
        x = spread[None, i : i + _CHUNK] + shift
        np.minimum(out, _permute(x, 0x85EBCA6B, 0xC2B2AE35).min(1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts, out = sig.reshape(bands, rows).astype(np.uint64), np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = (out ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sketch(text: Column, k: int, bands: int, rows: int) -> Column:
    def make(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = words_of(t)
            sh = shingles(words, k)
            out.append((class_key(words), len(sh), band_keys(signature(sh, bands * rows), bands, rows) if len(sh) else None))
        give_back()
        return pd.DataFrame(out, columns=["key", "n", "bands"])

    return F.pandas_udf(make, "key binary, n long, bands array<long>")(text)


def _full_set(text: Column, k: int) -> Column:
    def make(texts: pd.Series) -> pd.DataFrame:
        out = [(class_key(w), shingles(w, k).view(np.int64)) for w in map(words_of, texts)]
        give_back()
        return pd.DataFrame(out, columns=["key", "set"])

    return F.pandas_udf(make, "key binary, set array<long>")(text)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, ...) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select(*pairs.columns)


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links (ca, cb) between components."""
    moved = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    return cut(label.join(moved, F.col("component") == F.col("_old"), "left").select("key", F.coalesce("_new", "component").alias("component")))


def tile_links(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, within: bool, percent: int) -> list[tuple[int, int]]:
    """Components (as positions in `component`) that confirmed links join, as a forest.

    side: 0 or 1; rows of side 1 are compared with those of side 0, within: with each other too, but not within a component. Common shingles are counted by products of 0/1 matrices.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    first, second = np.flatnonzero(side == 1), np.arange(len(sets)) if within else np.flatnonzero(side == 0)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    of, column = of[shared], column[shared]
    wide, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(first), len(second)), np.float32)
    for lo in range(0, len(wide), _COLUMNS):
        mine = (column >= lo) & (column < lo + _COLUMNS)
        block = np.zeros((len(sets), min(_COLUMNS, len(wide) - lo)), np.float32)
        block[of[mine], column[mine] - lo] = 1
        common += block[first] @ block[second].T
    _, name = np.unique(component, return_inverse=True)
    linked = common * 100 >= (sizes[first][:, None] + sizes[second][None] - common) * percent
    linked &= name[first][:, None] != name[second][None]
    a, b = np.nonzero(linked)
    label = np.arange(name.max() + 1)
    lower_labels(label, name[first[a]], name[second[b]])
    at = np.full(len(label), -1)
    at[name[::-1]] = np.arange(len(name))[::-1]
    return [(int(at[c]), int(at[label[c]])) for c in range(len(label)) if label[c] != c]


def tiles_of(rows: DataFrame) -> DataFrame:
    """(main, kind, lo, hi, key, component, side) of rows (main, key, component, n, beside).

    Rows beside a main component are dealt into chunks of bounded rows and shingles, and so are the main component's. A tile is
    a chunk beside with one of the main component's (kind 0, and with itself where that one is the first) or with another
    beside (kind 1): members of the main component are never compared with each other.
    """
    size = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    counts = rows.groupBy("main", "beside").agg(size.alias("chunks"))
    counts = counts.groupBy("main").agg(F.max(F.when(F.col("beside"), F.col("chunks"))).alias("right"), F.max(F.when(~F.col("beside"), F.col("chunks"))).alias("left"))
    rows = rows.join(counts, "main").withColumn("mine", F.pmod(F.xxhash64("key"), F.when(F.col("beside"), F.col("right")).otherwise(F.col("left"))).cast("int"))
    tile = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.col("mine")
    with_main = F.transform(upto("left"), lambda o: tile(0, mine, o, 1))
    others = F.filter(upto("right"), lambda o: o != mine)
    with_beside = F.transform(others, lambda o: F.struct(F.lit(1).alias("kind"), F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"), (mine > o).cast("int").alias("side")))
    tiles = F.when(F.col("beside"), F.concat(with_main, with_beside)).otherwise(F.transform(upto("right"), lambda o: tile(0, o, mine, 0)))
    return rows.withColumn("t", F.explode(tiles)).select("main", "t.kind", "t.lo", "t.hi", "key", "component", "t.side")


def _compare_tiles(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (ca, cb) between components that share one of the buckets of (bucket, key, n, component).

    Around the largest component of each bucket, by its rows in buckets, a group is made of the rows of it and of the components
    beside it that stand in open buckets; each tile is one task, which returns a forest of components. So no pair is ever a row.
    """
    people = cut(placed.select("key", "component", "n").distinct())
    sizes = people.groupBy("component").agg(F.count("*").alias("size"))
    held = placed.select("bucket", "component").distinct().join(sizes, "component")
    main = held.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    beside = cut(held.select("bucket", "component").join(main, "bucket").where("component <> main").select("main", "component").distinct())
    right = beside.join(people, "component").select("main", "key", "component", "n", F.lit(True).alias("beside"))
    left = beside.select(F.col("main").alias("component")).distinct().join(people, "component").select(F.col("component").alias("main"), "key", "component", "n", F.lit(False).alias("beside"))
    dealt = tiles_of(cut(left.unionByName(right)))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        names = tile["component"].to_numpy()
        found = tile_links([np.asarray(s) for s in tile["set"]], names, tile["side"].to_numpy(), bool(tile["kind"].iloc[0] == 0 and tile["hi"].iloc[0] == 0), percent)
        give_back()
        return pd.DataFrame({"ca": [names[i] for i, _ in found], "cb": [names[j] for _, j in found]})

    return dealt.join(sets, "key").groupBy("main", "kind", "lo", "hi").applyInPandas(compare, "ca binary, cb binary")


def _components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, component) of the members of (bucket, key, n), by confirmed links between members of one bucket.

    In each of some rounds, each bucket that holds several components has one of its members, another
    one each time, compared with the members of other components. Most of a group is connected then; what is
    left apart is compared in tiles, so that no candidate pair of different components is left out.
    """
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    label = members.select("key").distinct().withColumn("component", F.col("key"))
    placed = members.withColumn("component", F.col("key"))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            one = F.struct("key", "n", "component")
            other = placed.groupBy("bucket").agg(F.min_by(one, F.struct(F.xxhash64("key", F.lit(turn)), "key")).alias("y"))
            pairs = placed.select("bucket", one.alias("x")).join(other, "bucket").where((F.col("x.component") != F.col("y.component")) & near(F.col("x.n"), F.col("y.n")))
            pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).dropDuplicates(["a", "b"])
            links = _confirm(pairs, sets, percent).select("ca", "cb").distinct()
        else:
            links = _compare_tiles(placed, sets, percent)
        links = cut(links)
        if not links.isEmpty():
            label = _merge(label, links)
        if turn == ROUNDS:
            return label
        placed = placed.select("bucket", "key", "n").join(label, "key")
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
        placed = cut(placed.join(open_, "bucket"))
        if placed.isEmpty():
            return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of the input."""
    with scratch() as keep:
        given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        seen = cut(given.select("doc_id", _sketch(F.col("text"), k, bands, rows).alias("s")).select("doc_id", "s.*"))
        told = seen.where("doc_id IS NOT NULL AND n > 0")
        classes = told.groupBy("key").agg(F.min("doc_id").alias("rep"))
        reps = cut(told.join(classes.withColumnRenamed("rep", "doc_id"), ["key", "doc_id"]).dropDuplicates(["key"]).select("key", F.col("doc_id").alias("rep"), "n", "bands"))
        reps = reps.select("key", "rep", "n", F.explode("bands").alias("bucket"))
        shared = reps.groupBy("bucket").agg(F.count("*").alias("_members")).where("_members > 1").select("bucket")
        members = cut(reps.join(shared, "bucket", "left_semi"))
        wanted = members.select(F.col("key").alias("_key"), F.col("rep").alias("doc_id")).distinct()
        full = given.join(wanted, "doc_id").select("_key", _full_set(F.col("text"), k).alias("s")).where("s.key = _key").select("s.*")
        sets = cut(full.dropDuplicates(["key"]))
        label = _components(members.select("bucket", "key", "n"), sets, percent)
        ids = classes.join(label, "key")
        least = ids.groupBy("component").agg(F.min("rep").alias("component_id"))
        of_key = cut(ids.join(least, "component").select("key", "component_id"))
        keep(seen, of_key)
    out = seen.select("doc_id", "key", "n").join(classes, "key", "left").join(of_key, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
