"""License scans over a positional rare-token index, with DataFrame functions only.

Licence templates are short sequences of words. How many texts hold each template word gives its
inverse document frequency; a template is looked up by the rarest of those words without which it can't
stand. A file's positions of such words, moved back by their place in the template, are the starts at which the
template may stand; for exact phrases the positions of all words are intersected that way, for longer notices the
other words are compared in place, and mandatory key phrases must stand at their own relative position. So a
notice is looked up by one word of its key phrases, or, if it has none, by so many words that one stands in place.

The only thing collected is the count of texts for each template word, a fixed number of rows.

Defined results: null and empty texts have no words and no labels. Whole texts are read. Equal rows get
equal results. Ties of rarity go to the earlier word. An empty table gives an empty table. Input
columns pass through unless an added column has their name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Words after lower-casing A-Z: digits, a-z and everything beyond ASCII. Here with A-Z, as words are lower-cased one by one.
#: Said by what is in them: java.util.regex takes many times as long for the negation of several ranges.
WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Template:
    """A licence's words. key: mandatory phrases within them; exact templates are their own key phrase."""

    label: str
    words: str
    key: tuple[str, ...] = ()

    @property
    def list(self) -> list[str]:
        return self.words.split()


#: The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license"),
    Template("apache", "apache license"),
    Template("cc-by", "cc by"),
    Template("mit", "mit license"),
)
#: Opening words of common licence notices, with phrases that tell them apart.
NOTICES = (
    Template("agpl", "gnu affero general public license", ("affero general",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general",)),
    Template("mpl", "mozilla public license", ("mozilla public license",)),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted free of charge",)),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose", ("modify and or distribute",)),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("apache-notice", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of", ("free software you can redistribute it",)),
    Template("unlicense-notice", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
)
#: Share of a notice's words that must stand in place.
SHARE = 0.8


def _postings(words: Column, vocabulary: list[str]) -> Column:
    """array<struct<w, at>>: where the vocabulary's words stand. The length test keeps out what becomes ASCII only by lower-casing."""
    placed = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("at"), F.octet_length(w).alias("b")))
    return F.filter(placed, lambda x: x["w"].isin(vocabulary) & (F.octet_length(x["w"]) == x["b"]))


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How many texts hold each word, over all of them."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))
    held = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in rows}


def scan_licenses(docs: DataFrame, text: str = "text", base=BASE, notices=NOTICES, columns: list[str] | None = None) -> DataFrame:
    """Adds n_words, base_hits (array<struct<at, label>>, by place), notice_hits (array<struct<label, at, share>>).

    columns: the input's columns to return, all by default.
    """
    made = ("n_words", "base_hits", "notice_hits")
    columns = [c for c in (columns or docs.columns) if c not in made]
    counts = document_counts(docs, sorted({w for t in (*base, *notices) for w in t.list}), text)
    rare = lambda t: sorted(range(len(t.list)), key=lambda j: (counts[t.list[j]], j))
    sought = {t: _sought(t, rare(t)) for t in notices}
    anchors = {t.list[rare(t)[0]] for t in base} | {t.list[j] for t in notices for j in sought[t]}
    lookup = sorted({w for t in base for w in t.list} | anchors)
    words = F.coalesce(F.regexp_extract_all(docs[text], F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))
    seen = docs.select(packed(docs, columns), words.alias("_words"))
    seen = seen.select("_in", "_words", F.size("_words").cast("long").alias("n_words"), _postings(F.col("_words"), lookup).alias("_at"))
    starts = lambda t, j: F.transform(F.filter(F.col("_at"), lambda x: x["w"] == t.list[j]), lambda x: x["at"] - j)

    def exact(t: Template) -> Column:
        here = reduce(F.array_intersect, [starts(t, j) for j in rare(t)])
        return F.transform(here, lambda s: F.struct(s.alias("at"), F.lit(t.label).alias("label")))

    def near(t: Template) -> Column:
        in_place = lambda s, j: F.coalesce(F.lower(F.get(F.col("_words"), s + j)) == t.list[j], F.lit(False))
        here = F.filter(F.array_distinct(F.concat(*[starts(t, j) for j in sought[t]])), lambda s: s >= 0)
        share = lambda s: reduce(lambda a, b: a + b, [in_place(s, j).cast("int") for j in range(len(t.list))]) / F.lit(float(len(t.list)))
        keyed = lambda s: reduce(lambda a, b: a & b, [in_place(s, k) for phrase in t.key for k in _places(t, phrase)], F.lit(True))
        scored = F.transform(F.filter(here, keyed), lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("at"), share(s).alias("share")))
        return F.filter(scored, lambda x: x["share"] >= SHARE)

    some = F.exists("_at", lambda x: x["w"].isin(sorted(anchors)))
    hits = F.array_sort(F.concat(*[exact(t) for t in base]))
    more = F.array_sort(F.concat(*[near(t) for t in notices]))
    return seen.select(
        *unpacked(columns),
        "n_words",
        F.when(some, hits).otherwise(F.array().cast("array<struct<at:int,label:string>>")).alias("base_hits"),
        F.when(some, more).otherwise(F.array().cast("array<struct<label:string,at:int,share:double>>")).alias("notice_hits"),
    )


def _sought(t: Template, rare: list[int]) -> list[int]:
    """Places of which one at least holds its word wherever a notice stands; rare: all places, the rarest word first."""
    key = {k for phrase in t.key for k in _places(t, phrase)}
    if key:
        return [j for j in rare if j in key][:1]
    n = len(rare)
    return rare[: 1 + sum(m / n >= SHARE for m in range(n))]  # one more than may be missing


def _places(t: Template, phrase: str) -> range:
    """Where a key phrase stands in its template."""
    wanted = phrase.split()
    at = next(i for i in range(len(t.list)) if t.list[i : i + len(wanted)] == wanted)
    return range(at, at + len(wanted))
