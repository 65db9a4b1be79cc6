"""The trie walk against the tokenizers library, and round trips."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm.bpe import TrieBpe, ids_of, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return TrieBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(1)
    out = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaaaaaaaaaaaaaaa", "  \n\n\t x", " " * 300, "don't 's x² ½y Ⅻ ٣٤ a_b __", "a\x1cb \x1d", "é      x　 ​", "x" * 20_000 + "yz" * 5_000]
    out += ["".join(rnd.choice("abcdethionr  éü日本語'\n0123!?") for _ in range(rnd.randint(1, 200))) for _ in range(1500)]
    return out + ["".join(chr(rnd.choice([rnd.randint(32, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(60)) for _ in range(300)]


def test_ids_and_text_equal_the_library(ours, library):
    rows = texts()
    for text, packed, want in zip(rows, ours.encode_batch(rows), library.encode_batch(rows, add_special_tokens=False), strict=True):
        assert ids_of(packed) == want.ids, text[:80]
        assert ours.decode(packed) == library.decode(want.ids, skip_special_tokens=False)


def test_what_is_forgotten_is_encoded_alike(ours):
    rows = texts()[:200]
    before = ours.encode_batch(rows)
    ours.words.clear()
    ours.older.clear()
    ours.pairs.clear()
    assert [ours.encode_batch([r])[0] for r in rows] == before


def test_driver_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in round_trip(docs, PATH).collect():
        assert ids_of(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")


def test_odd_rows(odd_docs, no_docs, library):
    got = round_trip(odd_docs, PATH)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(ids_of(r["ids"]) == library.encode(r["text"] or "").ids for r in rows)
    assert round_trip(no_docs, PATH).count() == 0
    assert got.where(F.col("text").isNull()).first()["ids"] == b""
