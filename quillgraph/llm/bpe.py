"""Byte-level BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a batch of texts form a trie of bytes. A depth-first walk keeps, for every
prefix on the current path, the last token of that prefix's encoding. The last token of a longer
prefix is the one vocabulary entry that ends there and whose pairing with the last token before it
leaves both whole under the merge rules. So what words share at their start is encoded once, and an
encoding is read off by stepping back from token to token.

Defined results: null text is encoded like the empty text (no ids, decoded text empty). Texts of any
length are encoded whole. Rows keep their order and number; other columns pass through. Equal rows get
equal results. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

#: The pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for Python's faster re, most common branch first (no text fits both it and a contraction). It
#: holds for texts without numerals that aren't decimal digits, which re takes for letters, and without
#: the separators 1C to 1F, which it takes for white space.
_PATTERN = r""" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_OTHER = frozenset("\x1c\x1d\x1e\x1f").union(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Word encodings (twice as many at most) and token pairs that a Python worker remembers, at 100 to 180 bytes each: a bound of memory, not of results.
REMEMBERED_WORDS = 300_000


class TrieBpe:
    """Encodes and decodes with the contents of a byte-level BPE vocabulary file."""

    #: Automaton steps that are remembered: a bound of memory, not of results.
    REMEMBERED_STEPS = 400_000

    def __init__(self, file_content: str, remembered_words: int = REMEMBERED_WORDS):
        self.remembered_words = remembered_words
        spec = json.loads(file_content)
        to_byte = byte_alphabet()
        vocab = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.size_of = list(map(len, self.bytes_of))
        self.sizes, self.flat = np.array(self.size_of, np.int32), np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[tuple[int, int], int] = {}
        whole = spec["model"]["vocab"]
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made, x, y = whole[a + b], whole[a], whole[b]
            self.merge[x, y] = r
            self.rank[made], self.left[made], self.right[made] = r, x, y
        reachable = {t: i for t, i in vocab.items() if self.rank[i] < 0 or self._apart(self.left[i], self.right[i], self.rank[i])}
        self._build_endings(reachable)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.exact, self.fast = regex.compile(PATTERN).findall, re.compile(_PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of rank below `until` joins anything across the border of tokens a and b.

        The merges that made a and b are undone at the border, latest first; at each moment the two
        parts that touch may be joined only before one of them goes into its own larger token. Of
        equal ranks the left one is applied first.
        """
        rank, merge, pa, pb = self.rank, self.merge, until, until
        while True:
            m = merge.get((a, b))
            if m is not None and m < pa and m <= pb and m < until:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                pa, a = ra, self.right[a]
            elif rb >= 0:
                pb, b = rb, self.left[b]
            else:
                return True

    def _build_endings(self, tokens: dict[bytes, int]) -> None:
        """An automaton over bytes whose state tells which tokens end at the current byte, longest first."""
        step: dict[int, int] = {}  # state * 256 + byte: state
        ends: list[tuple[tuple[int, int], ...]] = [()]
        back, order = [0], []
        for t in sorted(tokens, key=len):
            state = 0
            for b in t:
                key = state << 8 | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(())
                    back.append(0)
                    order.append(key)
                state = step[key]
            ends[state] = ((len(t), tokens[t]),)
        depth = [0] * len(ends)
        for key in order:
            depth[step[key]] = depth[key >> 8] + 1
        for key in sorted(order, key=lambda k: depth[step[k]]):
            state, parent, b = step[key], key >> 8, key & 255
            if parent:
                at = back[parent]
                while at and (at << 8 | b) not in step:
                    at = back[at]
                back[state] = step.get(at << 8 | b, 0)
            ends[state] += ends[back[state]]
        self.step, self.ends, self.back = step, ends, back

    def _next(self, state: int, b: int) -> int:
        at = state
        while at and (at << 8 | b) not in self.step:
            at = self.back[at]
        found = self.step.get(at << 8 | b, 0)
        if len(self.step) < self.REMEMBERED_STEPS:
            self.step[state << 8 | b] = found
        return found

    def find(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces."""
        plain = not any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _OTHER.isdisjoint(text)
        return self.fast(text) if plain else self.exact(text)

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Packed token ids of distinct words, by one depth-first walk over their trie.

        Sorted words are the trie in the order of that walk: each word leaves the path at the end of
        what it shares with the one before it, so a trie node is met once and only the path is held.
        """
        last, states, before = [0], [0], b""
        step, ends, pairs, size_of, swap = self.step, self.ends, self.pairs, self.size_of, sys.byteorder == "big"
        if len(pairs) > self.remembered_words:
            pairs.clear()
        for word in sorted(words):
            w = word.encode()
            depth = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                depth += 1
            before = w
            del last[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for b in w[depth:]:
                depth += 1
                key = state << 8 | b
                state = step[key] if key in step else self._next(state, b)
                for size, t in ends[state]:
                    if size == depth:
                        break
                    pair = last[-size] << 20 | t
                    if pair in pairs:
                        if pairs[pair]:
                            break
                    else:
                        ok = pairs[pair] = self._apart(pair >> 20, t)
                        if ok:
                            break
                last.append(t)
                states.append(state)
            ids = []
            while depth:
                t = last[depth]
                ids.append(t)
                depth -= size_of[t]
            made = array("I", ids[::-1])
            if swap:
                made.byteswap()
            yield word, made.tobytes()

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        parts: list[list[tuple[bytes | None, list[str]]]] = []
        seen: set[str] = set()
        for text in texts:
            row = []
            for k, p in enumerate(self.split(text) if self.split and text else [text or ""]):
                if k % 2:
                    row.append((np.array([self.special[p]], "<u4").tobytes(), []))
                elif p:
                    found = self.find(p)
                    seen.update(found)
                    row.append((None, found))
            parts.append(row)
        if len(self.words) > self.remembered_words:
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        seen.difference_update(known)
        again = seen & older.keys()
        known.update((w, older[w]) for w in again)
        seen -= again
        known.update(self.encode_words(seen))
        of = known.__getitem__
        out = [b"".join([s if s is not None else b"".join(map(of, f)) for s, f in row]) for row in parts]
        for w in seen:
            if len(w) > 200:  # not to be met again
                del known[w]
        return out

    def decode(self, packed: bytes) -> str:
        """The bytes of all ids, one after the other, as text; what isn't UTF-8 is replaced."""
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
        at += np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_loaded: dict[int, TrieBpe] = {}


def _of(key: int, content, remembered_words: int) -> TrieBpe:
    """One encoder for each vocabulary and Python worker."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TrieBpe(content.value, remembered_words)
    return _loaded[key]


class Bpe:
    """Column functions over one vocabulary file, which the driver reads and sends once (1.5 MB at most for 50,000 entries)."""

    def __init__(self, spark: SparkSession, path: str, remembered_words: int = REMEMBERED_WORDS):
        with open(path, encoding="utf-8") as f:
            content = f.read()
        sent, key = spark.sparkContext.broadcast(content), hash((content, remembered_words))

        @F.pandas_udf("binary")
        def encode(texts: pd.Series) -> pd.Series:
            out = pd.Series(_of(key, sent, remembered_words).encode_batch(texts), dtype=object)
            give_back()
            return out

        @F.pandas_udf("string")
        def decode(packed: pd.Series) -> pd.Series:
            one = _of(key, sent, remembered_words)
            return pd.Series([None if p is None else one.decode(p) for p in packed], dtype=object)

        @F.pandas_udf("ids binary, decoded string")
        def both(texts: pd.Series) -> pd.DataFrame:
            one = _of(key, sent, remembered_words)
            ids = one.encode_batch(texts)
            out = pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([one.decode(p) for p in ids], dtype=object)})
            give_back()
            return out

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, text: Column) -> Column:
        """Ids as packed little-endian unsigned 32-bit integers."""
        return self._encode(text)

    def decode(self, packed: Column) -> Column:
        return self._decode(packed)

    def both(self, text: Column) -> Column:
        """struct<ids, decoded>: what encode() gives and what decode() makes of it. decode(encode(...)) beside encode(...) would encode twice."""
        return self._both(text)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", remembered_words: int = REMEMBERED_WORDS) -> DataFrame:
    """Adds each text's packed ids and what they decode to; columns of these names are replaced."""
    bpe = Bpe(docs.sparkSession, path, remembered_words)
    made = bpe.both(F.col(text))
    return docs.withColumns({ids: made["ids"], decoded: made["decoded"]})


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
