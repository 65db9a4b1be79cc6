"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; every stage works on
everything its predecessor kept.

1. toxicity: documents that the classifier chain rejects go.
2. near_duplicates: one row of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, the one of least id.
3. secrets: secrets in texts are replaced by their kind in brackets; n_chars follows.
4. mixing: documents are repeated or left out until sources have their target weights.
5. encode: texts are encoded with a public byte-level vocabulary and decoded again.

Defined results: null texts and texts without words pass through the first four stages (no words, no secrets, size 0;
texts without words of a source are repeated or left out with it) and a null text encodes to no ids, 0 tokens and the digest of
an empty text. The near-duplicate stage goes by rows: of rows that repeat with id and text one stays, and rows with a null id
are compared too, after all others in order. Empty tables pass through. Additional columns of documents pass through the first
four stages. Each stage's intermediate tables are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, minhash, mixing, secret_scan, toxicity
from quillgraph.llm.common import cut, discard, for_python, packed, scratch, table, unpacked

VOCABULARY = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain is fitted on the labelled documents of the table and scores every document given."""
    for_python(spark)
    chain, names = toxicity.fit_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, chain, names)
    return scored.where(~F.col("rejected")).select(*[scored[c] for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    for_python(spark)
    rows = cut(docs.select(packed(docs, docs.columns), F.monotonically_increasing_id().alias("_row")))
    found = minhash.near_duplicates(rows.select("_row", F.col("_in")["text"].alias("text")), doc_id="_row").select(F.col("doc_id").alias("_row"), "component_id")
    found = cut(found.join(rows.select("_row", F.col("_in")["doc_id"].alias("_id")), "_row"))
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"].alias("_row"))
    gone = cut(found.join(stays, "_row", "left_anti").select("_row"))
    return rows.join(gone, "_row", "left_anti").select(*unpacked(docs.columns))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(docs, found="_secrets")
    some = F.size("_secrets") > 0
    text = F.when(some, secret_scan.redact(F.col("text"), F.col("_secrets"))).otherwise(F.col("text"))
    changed = {"text": text} | ({"n_chars": F.when(some, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.withColumns(changed).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the packed ids, their number, and a digest of what they decode to."""
    import public_tokenizers

    for_python(spark, 300)
    done = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), remembered_words=20_000)  # workers still hold what earlier stages left
    return done.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

#: SQL can't express the first stage, which trains a model, nor the last; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        with scratch() as keep:
            docs = cut(stage(spark, docs, sf_dir))
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
