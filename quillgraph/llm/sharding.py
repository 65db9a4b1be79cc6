"""Sharding by best-fit-decreasing bin packing.

Equal texts form an indivisible group. Groups are packed, largest first, each into the bin with the
least remaining capacity that still holds it; the bins stand in a balanced tree by remaining capacity.
`pack` minimises the number of bins of a fixed capacity; `into_shards` looks for the smallest capacity
at which the packing needs no more than the given number of bins, which makes sizes nearly equal.

Every group is packed that way. What reaches the driver is how many groups there are of each size, at most
sqrt(2 * bytes) rows, as different sizes add up to no more than all bytes. Groups of one size come one
after the other and fill the tightest bin while they fit, so a size is packed as a few runs of (bin, number); the
groups of a size take their bins by rank.

Defined results: null text has size 1 and all null texts are one group; so are all empty texts. A
group above the equal share has a shard of its own as far as shards go. Equal rows are in one shard
with different slots. An empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch

#: Groups of more than this part of all bytes or rows are placed without moving their rows.
PARTS = 4096
#: Rows that one slot window holds on average.
BLOCK_ROWS = 50_000


class CapacityTree:
    """A treap of (remaining capacity, bin); priorities are a hash of the bin, so that its depth stays logarithmic."""

    def __init__(self) -> None:
        self.root: list | None = None  # key, priority, left, right

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        return (key[1] * 0x9E3779B97F4A7C15 + key[0] * 0xC2B2AE3D27D4EB4F) * 0xFF51AFD7ED558CCD % (1 << 64) >> 7

    def _cut(self, node, key):
        """(nodes below key, nodes from key on)."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._cut(node[3], key)
            return node, right
        left, node[2] = self._cut(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = remaining, bin_
        left, right = self._cut(self.root, key)
        self.root = self._join(self._join(left, [key, self._priority(key), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin of least remaining capacity that holds `size`."""
        left, right = self._cut(self.root, (size, -1))
        found = right
        while found is not None and found[2] is not None:
            found = found[2]
        if found is None:
            self.root = left
            return None
        rest = self._cut(right, (found[0][0], found[0][1] + 1))[1]
        self.root = self._join(left, rest)
        return found[0]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, for items that are no larger than the capacity. Ties go by place, and to the lowest bin."""
    bins, tree, out = 0, CapacityTree(), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        remaining, b = tree.take_tightest(sizes[i]) or (capacity, bins)
        bins += b == bins
        out[i] = b
        tree.add(remaining - sizes[i], b)
    return out


def pack_runs(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """pack() for (size, number) in descending order of size: runs of (bin, number). None once more than `most` bins are needed."""
    bins, tree, out = 0, CapacityTree(), []
    for size, number in sizes:
        runs = []
        while number:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            here = min(number, found[0] // size) if size else number
            runs.append((found[1], here))
            tree.add(found[0] - here * size, found[1])
            number -= here
        out.append(runs)
    return out


def runs_into_shards(sizes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """into_shards() for (size, number) in descending order of size: runs of (shard, number)."""
    todo, left, rest, used = list(sizes), shards, sum(s * n for s, n in sizes), 0
    alone: list[list[tuple[int, int]]] = [[] for _ in sizes]
    first = 0
    while first < len(todo) and left > 1 and todo[first][0] * left > rest:
        size, number = todo[first]
        alone[first].append((used, 1))
        rest, used, left = rest - size, used + 1, left - 1
        todo[first] = size, number - 1
        first += number == 1
    mine = todo[first:]
    if not mine:
        return alone
    least = max(-(-rest // left), mine[0][0])
    fits = lambda c: pack_runs(mine, c, left) is not None
    steps = range(257)  # capacities up to twice the least, which always suffice
    lift = lambda k: least + -(-least * k // 256) if k < 256 else 2 * least + mine[0][0]
    capacity = lift(bisect_left(steps, True, key=lambda k: fits(lift(k))))
    fine = max(1, least // 256 // 16)
    while capacity - fine >= least and fits(capacity - fine):
        capacity -= fine
    return alone[:first] + [a + [(used + b, n) for b, n in runs] for a, runs in zip(alone[first:], pack_runs(mine, capacity), strict=True)]


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: items above the equal share one by one, the others at the smallest capacity that suffices."""
    order, out = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [0] * len(sizes)
    counted = [(s, sum(1 for _ in same)) for s, same in groupby(sizes[i] for i in order)]
    dealt = (b for runs in runs_into_shards(counted, shards) for b, n in runs for _ in range(n))
    for i, b in zip(order, dealt, strict=True):
        out[i] = b
    return out


def assign_shards(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per row of the input."""
    with scratch() as keep:
        spark = docs.sparkSession
        t = F.coalesce(F.col(text), F.lit(""))
        rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")).alias("_group")))
        all_rows, all_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        blocks = max(64, -(-all_rows // BLOCK_ROWS))
        groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("_block", F.pmod(F.xxhash64("_group"), F.lit(blocks)).cast("int")))
        sizes = sorted(((r[0], r[1]) for r in groups.groupBy("bytes").count().collect()), reverse=True)
        runs = []
        for (size, _), dealt in zip(sizes, runs_into_shards(sizes, shards), strict=True):
            lo = 0
            for shard, number in dealt:
                runs.append((size, lo, lo + number, shard))
                lo += number
        runs = spark.createDataFrame(runs, "_bytes long, _lo long, _hi long, shard int")
        before = Window.partitionBy("bytes").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = groups.groupBy("bytes", "_block").count().select(F.col("bytes").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        inside = Window.partitionBy("bytes", "_block").orderBy("_group")
        ranked = groups.withColumn("_n", F.row_number().over(inside) - 1).join(starts, (F.col("bytes") == F.col("_s")) & (F.col("_block") == F.col("_b")))
        rank = F.col("_start") + F.col("_n")
        found = cut(ranked.join(runs, (F.col("bytes") == F.col("_bytes")) & (rank >= F.col("_lo")) & (rank < F.col("_hi"))).select(F.col("_group").alias("_g"), "bytes", "n", "shard"))
        keep(rows, found)
    hot = (F.col("bytes") * PARTS > all_bytes) | (F.col("n") * PARTS > all_rows)  # fewer than 2 * PARTS groups, whose rows stay where they are
    own = F.broadcast(found.where(hot).select("_g", "shard"))
    rest = found.where(~hot).select("_g", "shard")
    here = rows["_group"] == F.col("_g")
    placed = rows.join(own, here).drop("_g").unionByName(rows.join(own.select("_g"), here, "left_anti").join(rest, here).drop("_g"))
    return with_slots(placed, shards, all_rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_slots(placed: DataFrame, shards: int, all_rows: int) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard. Rows are numbered in blocks by hash; a block starts where the ones before it end."""
    blocks = max(8, -(-all_rows // BLOCK_ROWS))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_block").count().select(F.col("shard").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("_n", F.row_number().over(inside) - 1)
    return numbered.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).withColumn("slot", (F.col("_start") + F.col("_n")).cast("long"))
