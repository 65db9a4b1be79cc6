"""The corpus pipeline against its stages done plainly."""

import hashlib
import os

import corpus_pipeline as P
import public_tokenizers
import pytest
from test_minhash import brute
from test_secret_scan import spans_of
from tokenizers import Tokenizer

from quillgraph.llm import toxicity
from quillgraph.llm.bpe import ids_of
from quillgraph.llm.common import cut, scratch
from quillgraph.llm.mixing import with_copies


def plain_redaction(text):
    out, at = [], 0
    for start, _, kind, end in spans_of(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_run_equals_plain_stages(spark, sf_dir, docs):
    chain, names = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, chain, names).where("rejected").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] not in bad]
    kept = {d for d, _, _, k in brute([r[:2] for r in rows], 5, 80) if k}
    clean = spark.createDataFrame([(d, plain_redaction(t), s) for d, t, s in rows if d in kept], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in with_copies(clean).collect()}
    library = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    want = []
    for r in clean.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want += [(r["doc_id"], ids, hashlib.sha256(r["text"].encode()).hexdigest())] * copies[r["doc_id"]]
    got = [(r["doc_id"], ids_of(r["ids"]), r["decoded_sha256"]) for r in P.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, sf_dir, docs):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(50), sf_dir).columns == docs.columns


def test_secret_stage_updates_n_chars(spark, sf_dir):
    docs = spark.createDataFrame([(1, "password=abcdef", "en", "s", 15), (2, "x", "en", "s", 9), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.secret_stage(spark, docs, sf_dir).collect()}
    assert got == {1: ("[assign]", 8), 2: ("x", 9), 3: (None, None)}


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_toxicity_stage_of_odd_rows(spark, sf_dir, odd_docs):
    extra = spark.createDataFrame([(99, "idiot scum moron " * 3, "en", "s", 1, "k", 7, None)], odd_docs.schema)
    assert rows_of(P.toxicity_stage(spark, odd_docs.unionByName(extra), sf_dir)) == rows_of(odd_docs)


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, sf_dir, odd_docs):
    got = rows_of(P.near_duplicate_stage(spark, odd_docs, sf_dir))
    ids = [r[0] for r in got]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, 8]))  # of five rows with one text the least id stays, once; texts without words stay
    assert set(got) <= set(rows_of(odd_docs))
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "x"), (3, "x")], "doc_id long, text string")
    assert rows_of(P.near_duplicate_stage(spark, alone, sf_dir)) == [(3, "x"), (None, "a b c d e f")]


def test_near_duplicate_stage_goes_by_text_where_ids_repeat(spark, sf_dir):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " more")], "doc_id long, text string")
    assert rows_of(P.near_duplicate_stage(spark, docs, sf_dir)) == [(1, a), (1, b)]


def test_secret_stage_of_odd_rows(spark, sf_dir, odd_docs):
    want = [(i, None if t is None else plain_redaction(t), *rest) for i, t, *rest in (tuple(r) for r in odd_docs.collect())]
    long = "word " * 30_000 + "[assign]"
    got = P.secret_stage(spark, odd_docs, sf_dir).collect()
    assert sorted(((*r[:4], *r[5:]) for r in got), key=repr) == sorted(((*r[:4], *r[5:]) for r in want), key=repr)
    assert {r["doc_id"]: r["n_chars"] for r in got}[3] == len(long) and long in {r["text"] for r in got}


def test_mixing_stage_repeats_by_rate(spark, sf_dir):
    """Source a weighs 5, b 2, null 1: with 40, 4 and 12 words targets are 63, 8 and 13, the second stopped at twice its size."""
    rows = [(i, "w " * 10, "a") for i in range(4)] + [(10, "x y z w", "b"), (20, "w " * 12, None), (21, None, None), (22, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {r["doc_id"]: r["count"] for r in P.mixing_stage(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert n[10] == 2 and all(n[i] in (1, 2) for i in (0, 1, 2, 3, 20))
    assert rows_of(P.mixing_stage(spark, docs, sf_dir)) == rows_of(P.mixing_stage(spark, docs, sf_dir))


def test_encode_stage_of_odd_rows(spark, sf_dir, odd_docs):
    library = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    want = [(r["doc_id"], None if r["text"] is None else library.encode(r["text"], add_special_tokens=False).ids, r["text"]) for r in odd_docs.collect()]
    got = P.encode_stage(spark, odd_docs, sf_dir)
    assert got.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_sha256"]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(((r["doc_id"], ids_of(r["ids"] or b""), r["n_tokens"], r["decoded_sha256"]) for r in got.collect()), key=repr) == sorted(((d, ids or [], len(ids or []), digest(t)) for d, ids, t in want), key=repr)


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_empty_documents_pass_through(spark, sf_dir, no_docs):
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, sf_dir).collect() == []


def test_intermediate_tables_are_deleted(spark, sf_dir):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).cache()
    for name, stage in P.STAGES[:-1]:
        with scratch() as keep:
            keep(cut(stage(spark, docs, sf_dir)))
        after = set(os.listdir(folder))
        assert len(after - before) == 1, name
        before = after
