"""Spans against Python's re, derived trigram queries, redaction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.secret_scan import BASE_RULES, RULES, Rule, find_secrets, redact, trigram_query


def spans_of(text, rules=RULES):
    out = []
    for i, r in enumerate(rules):
        out += [(m.start(), i, r.kind, m.end()) for m in re.finditer(r.regex, text or "", re.A) if len(m.group(r.value)) >= r.least]
    return sorted(out)


def got(df):
    return [(r["text"], [tuple(s) for s in r["secrets"]]) for r in df.collect()]


def samples():
    rnd = random.Random(3)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", "  ", "=", ":", '"', "'", "abc123", "é", "日", "AKIA", "AKIA" + "Z9" * 10, "deadbeef" * 4, "0f", "\n", "ghp_" + "a1" * 20, "xoxb-" + "1" * 12, "sk_live_" + "x" * 20, "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35, "eyJ" + "c" * 9 + ".eyJ" + "d" * 9 + ".e", "secret:token:abcdefgh"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(600)]


def test_spans_equal_re(spark):
    df = spark.createDataFrame(list(enumerate(samples())), "doc_id long, text string")
    seen = set()
    for text, found in got(find_secrets(df)):
        assert found == spans_of(text), text
        seen |= {s[2] for s in found}
    assert seen == {r.kind for r in RULES}


def test_many_matches_in_one_text(spark):
    text = " ".join(f"é token={'ab' * (i % 5)}{i} AKIA{'Z' * (i % 30)}" for i in range(6_000))
    ((_, found),) = got(find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert found == spans_of(text) and len(found) > 6_000


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_queries_are_mandatory(rule):
    clauses = trigram_query(rule.regex)
    if rule.kind == "hex":
        assert clauses is None
        return
    for text in samples():
        for m in re.finditer(rule.regex, text, re.A):
            assert any(all(t in m.group().lower() for t in c) for c in clauses)


def test_a_rule_without_trigrams_scans_fully(spark):
    df = spark.createDataFrame([(1, "x12-34y")], "doc_id long, text string")
    assert got(find_secrets(df, rules=(Rule("n", r"[0-9]+-[0-9]+"),)))[0][1] == [(1, 0, "n", 6)]


def test_odd_rows(odd_docs, no_docs):
    rows = got(find_secrets(odd_docs))
    assert len(rows) == odd_docs.count()
    assert all(found == spans_of(text) for text, found in rows)
    assert find_secrets(no_docs).count() == 0
    assert set(odd_docs.columns) < set(find_secrets(odd_docs).columns)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef123 x"), (2, "password=" + "ab12" * 8 + " z"), (3, "none")], "doc_id long, text string")
    out = [r[0] for r in find_secrets(df).orderBy("doc_id").select(redact(F.col("text"), F.col("secrets"))).collect()]
    assert out == ["é [assign] x", "[assign] z", "none"]


def test_plan_is_native(odd_docs):
    plan = find_secrets(odd_docs, BASE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
