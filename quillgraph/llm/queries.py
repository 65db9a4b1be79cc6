"""The queries that the driver runs for the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, license_scan, minhash, mixing, quality, repeats, secret_scan, sharding, toxicity
from .common import for_python, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.filter("secrets", lambda s: s["ord"] < len(secret_scan.BASE_RULES))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_python(spark, 5000)
    return embeddings.similarity_components(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_python(spark)
    done = repeats.remove_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, a probability for each category of the chain, rejected, kept."""
    for_python(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain, names = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, chain, names)
    return scored.select("doc_id", *[f"p_{k}" for k in names], "rejected", (~F.col("rejected")).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_python(spark)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_p")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    for_python(spark, 4000)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = license_scan.scan_licenses(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.transform("base_hits", lambda h: h["label"])
    more = F.transform("notice_hits", lambda h: h["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n = F.size("base_hits")
    starts = F.transform("base_hits", lambda h: h["at"].cast("long"))
    best = F.coalesce(F.array_max(F.transform("notice_hits", lambda h: h["share"])), F.lit(0.0))
    return seen.select("doc_id", "n_words", n.cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), F.when(n > 0, 1.0).otherwise(best).alias("score"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.with_copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    for_python(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_minhash": op10_minhash,
}


def _op1_sql() -> str:
    """Every rule's matches with the gaps before them, whose lengths add up to positions."""
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        regex = r.regex.replace("'", "''")
        whole = f"(?s)(.*?)({regex})"
        get = lambda g, whole=whole: f"regexp_extract_all(t, '{whole}', {g})"
        parts.append(f"SELECT r, {i} AS ord, '{r.kind}' AS kind, {get(1)} AS gaps, {get(2)} AS found, {get(2 + r.value)} AS vals, {r.least} AS least FROM d")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT r, ord, kind, least, unnest(gaps) AS gap, unnest(found) AS hit, unnest(vals) AS val, unnest(range(1, len(gaps) + 1)) AS n FROM m),
s AS (SELECT r, ord, kind, least, length(val) AS counts, sum(length(gap) + length(hit)) OVER (PARTITION BY r, ord ORDER BY n) AS stop, length(hit) AS l FROM e),
k AS (SELECT r, ord, kind, CAST(stop - l AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM s WHERE counts >= least),
a AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base,
 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


def _op8_sql() -> str:
    lowered = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = " UNION ALL ".join(f"SELECT r, p AS pos, '{t.label}' AS label, 1.0::DOUBLE AS share, 1 AS base FROM o WHERE w[p + 1:p + {len(t.list)}] = {listed(t.list)}" for t in license_scan.BASE)
    notices = []
    for t in license_scan.NOTICES:
        share = " + ".join(f"CASE WHEN w[p + {j + 1}] = '{x}' THEN 1 ELSE 0 END" for j, x in enumerate(t.list))
        places = [k for phrase in t.key for k in license_scan._places(t, phrase)]
        keyed = " AND ".join(f"w[p + {k + 1}] = '{t.list[k]}'" for k in places)
        notices.append(f"SELECT r, p AS pos, '{t.label}' AS label, ({share}) / {len(t.list)}.0::DOUBLE AS share, 0 AS base FROM o WHERE {keyed}")
    must = sorted({t.list[0] for t in license_scan.BASE} | {t.key[0].split()[0] for t in license_scan.NOTICES})  # one of them stands wherever something is found
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, w, unnest(range(0, len(w))) AS p FROM d WHERE list_has_any(w, {listed(must)})),
h AS ({base} UNION ALL {" UNION ALL ".join(notices)}),
a AS (SELECT r, count(*) FILTER (WHERE base = 1) AS n_base, min(pos) FILTER (WHERE base = 1) AS first_word, max(pos) FILTER (WHERE base = 1) AS last_word,
 array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base = 1))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
 FROM h WHERE share >= {license_scan.SHARE} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN a USING (r)"""


#: Every window of 50 bytes by itself.
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, doc_id, unnest(range(0, octet_length(b) - 49)) AS p, b FROM d WHERE doc_id IS NOT NULL),
v AS (SELECT r, doc_id, p, b[p + 1:p + 50] AS s FROM w),
m AS (SELECT s, min(doc_id) AS least FROM v GROUP BY s),
g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM v JOIN m USING (s) WHERE least < doc_id),
k AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
i AS (SELECT r, min(p) AS lo, max(p) + 50 AS hi FROM k GROUP BY r, k),
j AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS kept FROM i),
x AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(hex(b[kept + 1:lo]), '' ORDER BY lo) AS h FROM j JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(h, '') || hex(b[coalesce(last, 0) + 1:octet_length(b)]))) AS kept_sha256 FROM d LEFT JOIN x USING (r)"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
q AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS full_at FROM p),
l AS (SELECT *, ((SELECT sum(source_size) FROM q) * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0)) / ((SELECT sum(weight) FROM q) - coalesce(sum(weight) OVER w, 0.0)) AS level
 FROM q WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT min_by(level, (full_at, source)) FROM l WHERE level <= full_at) * weight), cap) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
 CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(floor(rate) AS INTEGER) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, CAST(copies AS INTEGER) AS copies FROM e"""

OP2_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
k AS (SELECT r, v, sqrt(list_inner_product(v, v)) AS n FROM d WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON a.r < b.r AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / a.n / b.n >= 0.95),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.t = e.a),
c AS (SELECT reach.r, min(d.vec_id) AS component_id FROM reach JOIN d ON reach.t = d.r GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS sh FROM p),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.t = e.a),
m AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.t = d.r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""

ORACLE_SQL = {"op2_embedding_dedup": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op10_minhash": OP10_SQL, "op1_secret_scan": _op1_sql(), "op8_license_scan": _op8_sql(), "op9_mixing": OP9_SQL}
