"""Removal of byte strings that repeat across documents, by suffix arrays.

Each byte covered by a string of `length` bytes that also starts in a document with a smaller id goes.

One suffix array over a corpus doesn't divide, so equal strings are brought together first. Every window of
`length` bytes has a key, the least hash of the `GRAMS[0]`-byte strings in it; equal windows have equal
keys, and neighbouring windows mostly share theirs, so a run of them is one stretch of text. Keys that one
text alone holds drop out. Equal stretches are put in once, with the least id of their documents, and the
suffix arrays of each key's stretches (by linear grouping construction) bring equal windows side by side: each
gets the least id among all documents that hold it. Going back to every place of a stretch, the windows
whose least id is below the document's own are removed.

Nothing is gathered without bound. Equal texts stand for one, and one of a smaller id takes all bytes of the
others. A key with more than `CROWD` different stretches is split: its windows are keyed again by longer
strings, in the end by themselves. A stretch has at most `RUN` windows. Windows whose hash no other window of
their key has aren't sorted, as they repeat nowhere; equality is never taken from these hashes. Equal texts and
stretches are told by SHA-256 and BLAKE2b, of 128 bits.

Texts are stored once, dealt by row, and joined there with what later steps found, so that they aren't shuffled again.

Defined results: null text is empty. Texts are UTF-8 bytes, whole, of any length. Rows with a null id
neither lose bytes nor cost others any; equal ids don't count as smaller. Equal rows get equal results. An empty
table gives an empty table. Input columns pass through unless an added column has their name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, give_back, packed, scratch, store, unpacked
from .suffix_array import ranges, suffix_arrays

#: Bytes of the strings whose least hash is a window's key, then of those that split crowded keys; windows themselves come last.
GRAMS = (20, 35)
#: Different stretches of a key that are sorted together, windows of a stretch, and text bytes for each bucket of keys.
CROWD, RUN, BUCKET_BYTES = 16_384, 256, 64 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string: strings of doubling length are put together."""
    powers, sized, size = {1: x}, 1, 1
    while size * 2 <= k:
        h = powers[size]
        powers[size * 2] = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    out, sized = powers[size], size
    while sized < k:
        size = max(s for s in powers if s <= k - sized)
        n = len(x) - sized - size + 1
        out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + powers[size][sized : sized + n]
        sized += size
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def window_keys(data: bytes, length: int, gram: int = GRAMS[0]) -> np.ndarray:
    """The key of each window of `length` bytes."""
    m, size, span = _grams(np.frombuffer(data, np.uint8).astype(np.uint64), gram), 1, length - gram + 1
    while size * 2 <= span:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    return np.minimum(m[: len(m) - (span - size)], m[span - size :]) if size < span else m


def _gram(level: int, length: int) -> int:
    return min(GRAMS[level], length) if level < len(GRAMS) else length


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are among the wanted ones, which are sorted."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run of equal keys, of at most RUN windows."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    if len(size) and size.max() > RUN:
        parts = -(-size // RUN)
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + within * RUN
        size = np.diff(np.append(first, len(keys)))
    return first, first + size


def _packed_by(home: np.ndarray, keys: np.ndarray, of: np.ndarray, rows: np.ndarray, more: np.ndarray, more_home: np.ndarray) -> list[tuple]:
    """(bucket, rows, counts, keys, more) for each bucket of `home` and `more_home`; of: the place of a key's row in `rows`."""
    by, there = np.lexsort((of, home)), np.argsort(more_home, kind="stable")
    home, keys, of, more, more_home = home[by], keys[by], of[by], more[there], more_home[there]
    pair = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (of[1:] != of[:-1])])) if len(home) else np.zeros(0, np.int64)
    counts, who, pair_home = np.diff(np.append(pair, len(home))).astype(np.int32), rows[of[pair]], home[pair]
    present = np.union1d(home, more_home)
    cuts = [np.searchsorted(x, present, side=side).tolist() for x in (pair_home, home, more_home) for side in ("left", "right")]
    return [(b, who[i:j].tobytes(), counts[i:j].tobytes(), keys[k:m].tobytes(), more[n:o].tobytes()) for b, i, j, k, m, n, o in zip(present.tolist(), *cuts, strict=True)]


def _keys_by_bucket(buckets: int, length: int):
    """(bucket, rows, counts, keys, more) of each batch.

    A key that several rows of a batch hold repeats for certain: its rows go to a bucket below 0, and its own
    bucket is told of it once (`more`), so that a key which is everywhere costs a few bytes a batch.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(window_keys(t.encode(), length, _gram(0, length))) for t in batch["text"]]
            if not found:
                continue
            rows, flat = batch["row"].to_numpy(np.int64), np.concatenate(found)
            of = np.repeat(np.arange(len(found)), [len(k) for k in found])
            keys, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
            several, more = counts[at] > 1, keys[counts > 1]
            bucket = lambda k: (k % np.uint64(buckets)).astype(np.int64)
            out = _packed_by(bucket(flat[~several]), flat[~several], of[~several], rows, more, bucket(more))
            out += _packed_by(-1 - of[several] % buckets, flat[several], of[several], rows, more[:0], np.zeros(0, np.int64))
            yield pd.DataFrame(out, columns=["bucket", "rows", "counts", "keys", "more"])

    return make


def _join(parts, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _repeated(bucket: pd.DataFrame) -> pd.DataFrame:
    """(row, keys): of each row, the keys of this bucket that other rows hold too."""
    keys, counts, rows = _join(bucket["keys"]), _join(bucket["counts"], np.int32), _join(bucket["rows"], np.int64)
    if bucket["bucket"].iloc[0] >= 0:
        names, at, often = np.unique(np.concatenate([keys, _join(bucket["more"])]), return_inverse=True, return_counts=True)
        kept = often[at[: len(keys)]] > 1
    else:
        kept = np.ones(len(keys), bool)
    ends = np.cumsum(counts)
    left = np.add.reduceat(kept, ends - counts) if len(counts) else counts
    keys, some = keys[kept], np.flatnonzero(left)
    ends = np.cumsum(left)
    return pd.DataFrame({"row": rows[some], "keys": [keys[a:b].tobytes() for a, b in zip((ends - left)[some].tolist(), ends[some].tolist(), strict=True)]})


def _name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


PLACE = "key long, name binary, n int, row long, doc_id long, first int"
CUT = "key long, name binary, least long, most long, kinds long, text binary"
FINER = "of binary, first int, key long, name binary, least long, most long, text binary"
SEGMENT = "name binary, a int, b int, least long"


def _stretches(length: int):
    """PLACE: where each row holds a run of windows with one of its given keys; n is its bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, names = [], []
            for row, doc, text, given in zip(batch["row"], batch["doc_id"], batch["text"], batch["keys"], strict=True):
                data = text.encode()
                keys = window_keys(data, length, _gram(0, length))
                lo, hi = runs(keys)
                held = _among(keys[lo], np.sort(_join(given)))
                lo, hi = lo[held], hi[held] + length - 1
                names += [_name(data[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
                out.append((keys[lo].view(np.int64), hi - lo, np.full(len(lo), row), np.full(len(lo), doc), lo))
            if out:
                key, n, row, doc, first = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"key": key, "name": names, "n": n, "row": row, "doc_id": doc, "first": first})
                give_back()

    return make


def _finer(length: int, level: int):
    """FINER: the stretches that the keys of a level make of stretches; of: the stretch they are in, first: their place there."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for of, least, most, text in zip(batch["name"], batch["least"], batch["most"], batch["text"], strict=True):
                data = bytes(text)
                keys = window_keys(data, length, _gram(level, length))
                for lo, hi in zip(*(x.tolist() for x in runs(keys)), strict=True):
                    piece = data[lo : hi + length - 1]
                    out.append((of, lo, int(keys[lo].view(np.int64)), _name(piece), least, most, piece))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FINER.split(", ")])

    return make


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """CUT: the bytes at the places of each text, with what names them."""
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in CUT.split(", ")}
        for text, places in zip(batch["text"], batch["places"], strict=True):
            data = text.encode()
            for p in places:
                for c in ("key", "name", "least", "most", "kinds"):
                    out[c].append(p[c])
                out["text"].append(data[p["first"] : p["first"] + p["n"]])
            if len(out["text"]) > 100_000:
                yield pd.DataFrame(out)
                out = {c: [] for c in out}
        yield pd.DataFrame(out)
        give_back()


def _hashes(texts: list[bytes], sizes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window of each text, many texts at a time."""
    begin = np.cumsum(sizes) - sizes
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, int(sizes.sum()), 1 << 17)), len(texts)))
    out = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        flat = np.frombuffer(b"".join(texts[i:j]), np.uint8).astype(np.uint64)
        out.append(_grams(flat, length)[ranges(begin[i:j] - begin[i], sizes[i:j] - length + 1)])
    return np.concatenate(out)


def least_ids(keys: np.ndarray, texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each text, the least id of the texts of its key that hold it; and how many windows each text has."""
    sizes = np.array([len(t) for t in texts])
    windows = sizes - length + 1
    begin, of = np.cumsum(windows) - windows, np.repeat(np.arange(len(texts)), windows)
    _, name, count = np.unique(_hashes(texts, sizes, length) + keys.view(np.uint64)[of] * np.uint64(_BASE), return_inverse=True, return_counts=True)
    often, least = count[name] > 1, docs[of]
    cuts = np.flatnonzero(np.concatenate([[True], (often[1:] != often[:-1]) | (of[1:] != of[:-1])]))  # runs of windows that may repeat, or don't
    ends, held = np.append(cuts[1:], len(often)), often[cuts]
    pieces: dict[tuple[int, bytes], list[int]] = {}  # equal runs of a key are sorted once: their least id, then their place
    spots = []
    for lo, hi, i, at in zip(cuts[held].tolist(), ends[held].tolist(), of[cuts[held]].tolist(), (cuts - begin[of[cuts]])[held].tolist(), strict=True):
        piece = pieces.setdefault((int(keys[i]), texts[i][at : at + hi - lo + length - 1]), [int(docs[i])])
        piece[0] = min(piece[0], int(docs[i]))
        spots.append((lo, hi, piece))
    if not spots:
        return least, windows
    by_key: dict[int, list[tuple[bytes, list[int]]]] = {}
    for (k, text), piece in pieces.items():
        by_key.setdefault(k, []).append((text, piece))
    laid = [p for same in by_key.values() for p in same]
    size = np.array([len(t) + 1 for t, _ in laid])  # a byte that no UTF-8 text holds follows each
    at = np.cumsum(size) - size
    for (_, piece), a in zip(laid, at.tolist(), strict=True):
        piece.append(a)
    problems = [b"".join(t + b"\xff" for t, _ in same) for same in by_key.values()]
    flat = np.frombuffer(b"".join(problems), np.uint8)
    problem = np.repeat(np.arange(len(problems)), [len(p) for p in problems])
    ids, room = np.repeat(np.array([p[0] for _, p in laid], np.int64), size), np.repeat(at + size - 1, size)
    order = suffix_arrays(problems)
    order = order[order + length <= room[order]]
    view = np.lib.stride_tricks.sliding_window_view(flat, length)
    fresh = np.ones(len(order), bool)
    for i in range(0, len(order) - 1, 65_536):  # windows side by side are compared byte by byte
        a = order[i : i + 65_537]
        fresh[i + 1 : i + len(a)] = (view[a[1:]] != view[a[:-1]]).any(1) | (problem[a[1:]] != problem[a[:-1]])
    starts = np.flatnonzero(fresh)
    found = np.empty(len(flat), np.int64)
    found[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(order))))
    for lo, hi, (_, a) in spots:
        least[lo:hi] = found[a : a + hi - lo]
    return least, windows


def _sorted_bucket(length: int):
    """(name, a, b, least): the windows a to b of a stretch stand in a document of a smaller id than the greatest that holds the stretch."""

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        flat, sizes = least_ids(rows["key"].to_numpy(np.int64), [bytes(t) for t in rows["text"]], rows["least"].to_numpy(np.int64), length)
        begin, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        first = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])]))
        end = np.append(first[1:], len(flat))
        kept = flat[first] < rows["most"].to_numpy(np.int64)[of[first]]
        first, end = first[kept], end[kept]
        text = of[first]
        give_back()
        return pd.DataFrame({"name": rows["name"].to_numpy()[text], "a": first - begin[text], "b": end - begin[text], "least": flat[first]})

    return make


def _carve(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What is left of each text when its spans are gone."""
    out = []
    for text, given in zip(texts, spans, strict=True):
        data = (text or "").encode()
        kept, at, removed, n = [], 0, 0, 0
        end = -1
        for s in sorted((s["from"], s["to"]) for s in given) if given is not None else ():
            lo, hi = s
            if lo > end:  # runs that touch are one
                n += 1
            if hi > end:
                lo = max(lo, at)
                kept.append(data[at:lo])
                removed += hi - lo
                at = end = hi
        kept.append(data[at:])
        out.append((removed, n, b"".join(kept)))
    give_back()
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_bytes"])


def _settled(told: DataFrame, level: int, length: int, buckets: int, used: list[DataFrame]) -> DataFrame:
    """SEGMENT for the stretches of CUT, by suffix arrays over the stretches of each key; crowded keys are split first."""
    last = _gram(level, length) == length
    few = told if last else told.where(F.col("kinds") <= CROWD)
    segments = few.withColumn("bucket", F.pmod("key", F.lit(4 * buckets))).groupBy("bucket").applyInPandas(_sorted_bucket(length), SEGMENT)
    crowded = told.where(F.col("kinds") > CROWD)
    if last or crowded.isEmpty():
        return segments
    finer = cut(crowded.select("name", "least", "most", "text").mapInPandas(_finer(length, level + 1), FINER))
    classes = finer.groupBy("key", "name").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("text").alias("text"))
    classes = cut(classes)
    inner = cut(classes.join(classes.groupBy("key").agg(F.count("*").alias("kinds")), "key"))
    used += [finer, classes, inner]
    found = _settled(inner, level + 1, length, buckets, used).withColumnRenamed("least", "of_all")
    up = finer.select("of", "first", "name").join(found, "name").select(F.col("of").alias("name"), (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"), F.col("of_all").alias("least"))
    return segments.unionByName(up)


def repeated_spans(texts: DataFrame, stand: DataFrame, parts: int, total: int, length: int = 50) -> DataFrame:
    """(row, spans): the bytes to remove of rows of (row, doc_id, text); spans may overlap.

    texts: dealt by row into `parts`, so that what is dealt alike joins them without a shuffle of text; stand: the rows
    to look at, of which no two have the same text; total: the bytes of all texts.
    """
    buckets = max(8, -(-total // BUCKET_BYTES))
    looked = texts.join(stand.select("row").hint("shuffle_hash"), "row", "left_semi").select("row", "text")
    keyed = looked.mapInPandas(_keys_by_bucket(buckets, length), "bucket long, rows binary, counts binary, keys binary, more binary")
    held = keyed.groupBy("bucket").applyInPandas(_repeated, "row long, keys binary")
    held = held.repartition(parts, "row").groupBy("row").agg(F.collect_list("keys").alias("keys"))  # a row's own keys, once each
    places = cut(texts.join(held.hint("shuffle_hash"), "row").select("row", "doc_id", "text", "keys").mapInPandas(_stretches(length), PLACE))
    classes = places.groupBy("key", "name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("row").alias("row"), F.min_by("first", "row").alias("first"), F.min("n").alias("n"))
    classes = cut(classes)
    keys = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("least").alias("from"), F.max("most").alias("to")).where("from < to").select("key", "kinds")
    classes_of = cut(classes.join(keys, "key"))
    discard(classes)
    whole = classes_of.where("kinds = 1").select("name", F.lit(0).alias("a"), (F.col("n") - (length - 1)).alias("b"), "least")
    wanted = classes_of.where("kinds > 1").repartition(parts, "row").groupBy("row").agg(F.collect_list(F.struct("key", "name", "first", "n", "least", "most", "kinds")).alias("places"))
    told = cut(texts.join(wanted.hint("shuffle_hash"), "row").select("text", "places").mapInPandas(_cut_out, CUT))
    used: list[DataFrame] = []
    segments = cut(whole.unionByName(_settled(told, 0, length, buckets, used)))
    discard(classes_of, told, *used)
    span = F.struct((F.col("first") + F.col("a")).alias("from"), (F.col("first") + F.col("b") + (length - 1)).alias("to"))
    spans = places.join(segments, "name").where("least < doc_id").select("row", span.alias("span"))
    out = cut(spans.groupBy("row").agg(F.collect_list("span").alias("spans")))  # within one row
    discard(places, segments)
    return out


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept_bytes.

    columns: the input's columns to return, all by default.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    columns = [c for c in (columns or docs.columns) if c not in made]
    id_, n = docs[doc_id].cast("long"), F.octet_length(docs[text])
    with scratch() as keep:
        total = docs.agg(F.sum(n.cast("long"))).first()[0] or 0
        digest = F.when(id_.isNotNull() & (n >= length), F.unhex(F.substring(F.sha2(docs[text].cast("binary"), 256), 1, 32)))
        rows = store(docs.select(packed(docs, columns), id_.alias("doc_id"), docs[text].alias("text"), n.alias("n"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "row", total)
        named = rows.where("digest IS NOT NULL").select("row", "doc_id", "n", "digest")
        firsts = named.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min_by("row", "doc_id").alias("stands"))
        roles = cut(named.join(firsts, "digest").select("row", "n", "stands", (F.col("doc_id") > F.col("least")).alias("copy")))
        texts = rows.select("row", "doc_id", "text")
        spans = repeated_spans(texts, roles.where("row = stands"), rows._quillgraph_parts, total, length)
        keep(rows, roles, spans)
    copies = roles.where("copy").select("row", F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to"))).alias("spans"))
    again = roles.where("NOT copy AND row <> stands").select("row", "stands")  # rows that repeat with id and text
    again = again.join(spans.withColumnRenamed("row", "stands"), "stands").select("row", "spans")
    both = rows.join(spans.unionByName(copies).unionByName(again).hint("shuffle_hash"), "row", "left")
    carve = F.pandas_udf(_carve, "n_removed long, n_spans long, kept_bytes binary")
    out = both.select("_in", F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes"), carve("text", "spans").alias("_c"))
    return out.select(*unpacked(columns), "n_bytes", "_c.*")
