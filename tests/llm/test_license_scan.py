"""Phrases and notices against plain Python."""

import math
import random
import re

from quillgraph.llm.license_scan import BASE, NOTICES, SHARE, Template, _places, document_counts, scan_licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    base = sorted((i, t.label) for t in BASE for i in range(len(words)) if words[i : i + len(t.list)] == t.list)
    notices = []
    for t in NOTICES:
        for i in range(len(words)):
            same = [i + j < len(words) and words[i + j] == w for j, w in enumerate(t.list)]
            if sum(same) / len(same) >= SHARE and all(same[k] for p in t.key for k in _places(t, p)):
                notices.append((t.label, i, sum(same) / len(same)))
    return len(words), base, sorted(notices)


def check(df):
    rows = scan_licenses(df).collect()
    for r in rows:
        assert (r["n_words"], [tuple(h) for h in r["base_hits"]], [tuple(h) for h in r["notice_hits"]]) == plain(r["text"])
    return rows


def test_equal_to_plain_python(spark):
    rnd = random.Random(4)
    pieces = ["GNU General Public License", "the Apache License", "CC-BY", "cc by", "MIT", "License", "mit license", "gnu lesser general public license", "x", "of", "é", "maKe", *[t.words for t in NOTICES], "permission is hereby granted free of charge to anyone obtaining one copy", "CC0 1.0 Universal"]
    texts = [rnd.choice([" ", ", ", ". "]).join(rnd.choice(pieces) for _ in range(rnd.randint(0, 8))) for _ in range(300)]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = {h["label"] for r in rows for h in [*r["base_hits"], *r["notice_hits"]]}
    assert labels == {t.label for t in (*BASE, *NOTICES)}


def test_only_ascii_case(spark):
    rows = check(spark.createDataFrame([(1, "MIT LICENSE mİt lıcense"), (2, "maKe mit-license")], "doc_id long, text string"))
    assert sum(len(r["base_hits"]) for r in rows) == 2


def test_notices_without_their_rarest_words(spark):
    """The rarest words of each notice are changed, as far as the share and the key phrase allow; the rest stands."""
    texts = ["Redistributions and use in source and binary forms with or without modification are permitted", "permissions to using copy modify and or distribute this software for any purpose"]
    rnd = random.Random(5)
    for t in NOTICES:
        key = {k for p in t.key for k in _places(t, p)}
        others = [j for j in range(len(t.list)) if j not in key]
        for _ in range(8):
            gone = set(rnd.sample(others, min(len(others), len(t.list) - math.ceil(SHARE * len(t.list)))))
            texts.append(" ".join("changed" if j in gone else w for j, w in enumerate(t.list)))
    filler = [*[t.words for t in NOTICES], *["source and binary forms affero hereby distribute unencumbered"] * 50]  # what is rare changes with them
    for more in ([], filler):
        rows = check(spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string"))
        assert all(r["notice_hits"] for r in rows if r["doc_id"] < len(texts))


def test_notice_without_key_phrase(spark):
    """Any words may be missing, as long as the share stands; the two rarest of ten as well."""
    t = Template("ten", "one two three four five six seven eight nine ten")
    texts = [" ".join("x" if j in (a, b) else w for j, w in enumerate(t.list)) for a in range(10) for b in range(a, 10)]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=(t,)).collect()
    assert all([h["at"] for h in r["notice_hits"]] == [0] for r in rows)
    assert [len(r["notice_hits"]) for r in scan_licenses(spark.createDataFrame([("x x x four five six seven eight nine ten",)], "text string"), notices=(t,)).collect()] == [0]


def test_odd_rows(odd_docs, no_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    assert scan_licenses(no_docs).count() == 0


def test_plan_is_native(odd_docs):
    plan = scan_licenses(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_document_counts(spark):
    rows = [(1, "MIT license, licenses; mit-License"), (2, "Apache LICENSE é mité license2 license"), (3, None), (4, ""), (5, "by\x1fcc ccby")]
    got = document_counts(spark.createDataFrame(rows, "doc_id long, text string"), ["license", "mit", "by", "cc", "gnu"])
    assert got == {"license": 2, "mit": 1, "by": 1, "cc": 1, "gnu": 0}
