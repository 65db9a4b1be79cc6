"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are no further apart than the squared distance 2 - 2c. They are
rotated and split into blocks of few dimensions; in at least one block a pair's squared distance is
within that block's share of the budget. So each block is range-joined under its share, over a grid on
the block's first three coordinates, and the union of what the blocks let through is verified by the
cosine of the given vectors in double precision. A pair that several blocks find counts in the first.

Cells of the grid are two radii wide; a vector also goes to those neighbouring cells that its radius reaches and
that are greater than its own, so each close pair meets in one cell. Cells with more rows than a tile are dealt
into chunks that are compared chunk by chunk. A tile returns counts of links and a forest of links, so
dense groups are never spread into pairs.

Equal vectors collapse into one with a weight first. Vectors that are null, empty or zero, or that hold
null or non-finite components, link with nothing; vectors of different lengths don't link. Rows with a
null id count as vectors and as links, have component null and are kept. Rows that share an id stay rows of their own, each
with the links and the component of its vector. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch
from .components import connected_components, lower_labels

#: Dimensions of a block, and of those how many its grid has.
BLOCK, GRID = 8, 3
TILE = 16_384
_ROWS, _PAIRS = 1024, 50_000


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix that depends on the dimension alone."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dim)) for i in range(0, dim, BLOCK)]


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Each block's squared distance, in proportion to its dimensions."""
    sizes = np.array([b.stop - b.start for b in blocks_of(dim)])
    return (2 - 2 * cosine) * sizes / dim


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vector, block, cell, home) of every place of the vectors; a cell has GRID coordinates."""
    dim = x.shape[1]
    y, out = unit(x) @ rotation(dim), []
    for k, (b, budget) in enumerate(zip(blocks_of(dim), budgets(dim, cosine), strict=True)):
        reach = np.sqrt(budget) * (1 + 1e-6) + 1e-9
        width = 2 * reach
        p = y[:, [min(b.start + i, b.stop - 1) for i in range(GRID)]]
        home = np.floor(p / width).astype(np.int64)
        meets = {-1: p - home * width <= reach, 0: np.ones(p.shape, bool), 1: (home + 1) * width - p <= reach}
        for to in product((-1, 0, 1), repeat=GRID):
            if to >= (0,) * GRID:  # as tuples: the first step that isn't 0 goes up
                who = np.flatnonzero(np.logical_and.reduce([meets[t][:, i] for i, t in enumerate(to)]))
                out.append((who, np.full(len(who), k), home[who] + to, np.full(len(who), not any(to))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def join_tile(x: np.ndarray, home: np.ndarray, weight: np.ndarray, chunk: np.ndarray, apart: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, label of each row) among the rows of one tile, for the pairs whose first block is this one.

    chunk: 0 or 1; apart: pairs are made across chunks only.
    """
    n, dim = x.shape
    u = unit(x)
    y = u @ rotation(dim)
    parts, budget = blocks_of(dim), budgets(dim, cosine)
    links, label = np.zeros(n, np.int64), np.arange(n)
    # one of a pair is at home; the others needn't meet here
    mine = lambda c, h: np.flatnonzero((chunk == c) & (home == h))
    if apart:
        sides = [(mine(0, True), np.flatnonzero(chunk == 1)), (mine(0, False), mine(1, True))]
    else:
        sides = [(h := np.flatnonzero(home), h), (h, np.flatnonzero(~home))]
    z = y[:, parts[block]].astype(np.float32)
    half, one = (z * z).sum(1, keepdims=True) / 2, np.ones((n, 1), np.float32)
    one_way, other = np.hstack([z, -half, one]), np.hstack([z, one, -half])  # their product is minus half the squared distance
    for rows, across in ((left[i : i + _ROWS], right[i if right is left else 0 :]) for left, right in sides for i in range(0, len(left), _ROWS)):
        near = np.flatnonzero(one_way[rows] @ other[across].T >= np.float32(-budget[block] / 2 - 1e-5))  # with room for single precision
        a, b = rows[near // max(len(across), 1)], across[near % max(len(across), 1)]
        once = home[a] & home[b] & (chunk[a] == chunk[b]) & (a >= b)
        a, b = a[~once], b[~once]
        for j in range(0, len(a), _PAIRS):
            p, q = a[j : j + _PAIRS], b[j : j + _PAIRS]
            for k in range(block + 1):
                d = y[p, parts[k]] - y[q, parts[k]]
                within = (d * d).sum(1) <= budget[k] * (1 + 1e-9)
                keep = within if k == block else ~within
                p, q = p[keep], q[keep]
            linked = np.einsum("ij,ij->i", u[p], u[q]) >= cosine
            p, q = p[linked], q[linked]
            links += np.bincount(p, weights=weight[q], minlength=n).astype(np.int64) + np.bincount(q, weights=weight[p], minlength=n).astype(np.int64)
            lower_labels(label, p, q)
    return links, label


def _places(cosine: float):
    """Of rows (key, v): (key, dim, block, cell, home) for every place."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key, size = batch["key"].to_numpy(), batch["v"].map(len).to_numpy()
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                who, block, cell, home = cells(np.stack(batch["v"].to_numpy()[mine]).astype(np.float64), cosine)
                yield pd.DataFrame({"key": key[mine[who]], "dim": int(dim), "block": block} | {f"c{i}": cell[:, i] for i in range(GRID)} | {"home": home})

    return make


def similarity_components(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of the input."""
    with scratch() as keep:
        given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
        valid = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda e: e != 0), F.lit(False))
        given = given.select("vec_id", F.when(valid, F.transform("v", lambda e: e + 0.0)).alias("v"))
        digest = F.when(F.col("v").isNotNull(), F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda e: e.cast("string"))))))
        keyed = cut(given.select("vec_id", digest.alias("key"), "v"))
        classes = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        first = keyed.where("key IS NOT NULL").dropDuplicates(["key"]).select("key", "v")
        kind = vectors.schema[embedding].dataType.elementType.simpleString()
        nodes = cut(classes.join(first, "key").withColumn("v", F.col("v").cast("array<float>" if kind == "float" else "array<double>")))
        cell = ["dim", "block", *(f"c{i}" for i in range(GRID))]
        placed = cut(nodes.select("key", "v").mapInPandas(_places(cosine), "key binary, dim int, block int, " + ", ".join(f"c{i} int" for i in range(GRID)) + ", home boolean"))
        full = placed.groupBy(*cell).count().select(*cell, F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
        both = placed.join(full, cell).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "mine").alias("lo"), F.greatest(o, "mine").alias("hi")))
        dealt = both.withColumn("t", F.explode(tiles)).select("key", "home", *cell, "t.lo", "t.hi", (F.col("mine") != F.col("t.lo")).cast("int").alias("chunk"))
        dealt = dealt.join(nodes.select("key", "weight", "v"), "key")

        def tile(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.reset_index(drop=True)
            one = rows.iloc[0]
            links, label = join_tile(np.stack(rows["v"].to_numpy()).astype(np.float64), rows["home"].to_numpy(bool), rows["weight"].to_numpy(np.int64), rows["chunk"].to_numpy(), bool(one["lo"] != one["hi"]), int(one["block"]), cosine)
            some = np.flatnonzero(links > 0)
            return pd.DataFrame({"key": rows["key"].to_numpy()[some], "links": links[some], "linked": rows["key"].to_numpy()[label[some]]})

        found = cut(dealt.groupBy(*cell, "lo", "hi").applyInPandas(tile, "key binary, links long, linked binary"))
        counts = found.groupBy("key").agg(F.sum("links").alias("links"))
        label = connected_components(found.select(F.col("key").alias("a"), F.col("linked").alias("b")))
        ids = classes.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        ids = ids.join(ids.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("key", "component_id", "weight")
        ids = cut(ids.join(counts, "key", "left"))
        keep(keyed, ids)
    out = keyed.select("vec_id", "key").join(ids, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    n_links = F.when(F.col("key").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
