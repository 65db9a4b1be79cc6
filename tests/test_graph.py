"""Merging, building, the pattern language, sources, sinks and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph import sources, streaming, testbed
from quillgraph.functions.naming import element_id
from quillgraph.operators import extract as X
from quillgraph.operators import graph as G
from quillgraph.operators.routing import ask, graph_stats, rich_content
from quillgraph.plans import pattern
from quillgraph.plans.catalog import CATALOG, named
from quillgraph.plans.cypher import query
from quillgraph.sources import sinks


def toy(spark):
    papers = spark.createDataFrame([("1", "A", "abc", "2024-01-02", None, "cs", ["Ann", " Bob "]), ("2", "B", "def", "2024-01-01", None, "cs", ["Ann"]), ("3", "C", None, "2024", None, "cs", [])], "arxiv_id string, title string, abstract string, published string, pdf_url string, primary_category string, authors array<string>")
    texts = spark.createDataFrame([("1", {"methods": ["BERT"], "datasets": ["COCO"], "concepts": ["Deep Nets", "ab"], "metrics": ["mAP"]}), ("9", {"methods": ["GPT"]})], "paper_id string, entities map<string,array<string>>")
    rows = [[f"m{i}" if i else "x", str(i)] for i in range(25)]
    tables = X.with_element_ids(spark.createDataFrame([("1", 3, 1, "t", 2, 25, True, ["Method", "F1"], rows)], "paper_id string, page_number int, table_index int, content string, col_count int, row_count int, is_benchmark boolean, headers array<string>, rows array<array<string>>"), "table", "table_index")
    equations = X.with_element_ids(spark.createDataFrame([("1", 1, 1, "x=1", "raw_text"), ("1", 1, 2, "x", "raw_text")], "paper_id string, page_number int, eq_index int, latex string, source string"), "equation", "eq_index")
    figures = X.with_element_ids(spark.createDataFrame([("2", 1, 1, "figure", "Figure 1", "cap", None)], "paper_id string, page_number int, i int, element_type string, fig_number string, content string, image_path string"), "figure", "i")
    return G.build_graph(spark, " My Topic ", papers, texts, tables, equations, figures)


def counts(g):
    return {r["label"]: r["count"] for r in named(g, "graph_stats").collect()}, {r["type"]: r["count"] for r in named(g, "type_stats").collect()}


def test_build(spark):
    g = toy(spark)
    n, e = counts(g)
    assert n == {"Topic": 1, "Paper": 2, "Author": 2, "Method": 20, "Dataset": 1, "Concept": 1, "Table": 1, "Equation": 1, "Figure": 1}
    assert e == {"INCLUDES": 2, "WROTE": 3, "PROPOSES": 20, "USES_DATASET": 1, "MENTIONS": 1, "HAS_TABLE": 1, "HAS_EQUATION": 1, "HAS_FIGURE": 1}
    assert g.node("Topic").first()["name"] == "my topic"
    assert counts(toy(spark)) == (n, e)
    assert g.node("Method").where("name = 'BERT'").first()["from_table"] is None
    assert sorted(r["name"] for r in g.node("Author").collect()) == ["Ann", "Bob"]


def test_tables_whose_digests_begin_alike_stay_apart(spark):
    papers = spark.createDataFrame([(p, "T", "abc", "2024", None, "cs", []) for p in ("4285960", "1344792")], "arxiv_id string, title string, abstract string, published string, pdf_url string, primary_category string, authors array<string>")
    texts = spark.createDataFrame([], "paper_id string, entities map<string,array<string>>")
    told = [("4285960", 1, 56142656349, "t", 2, 1, True, ["Method", "F1"], [["x", "9"]]), ("1344792", 1, 17220308943, "u", 2, 1, False, ["Method", "Price"], [["y", "9"]])]
    told = spark.createDataFrame(told, "paper_id string, page_number int, table_index long, content string, col_count int, row_count int, is_benchmark boolean, headers array<string>, rows array<array<string>>")
    short = told.select(element_id(F.col("paper_id"), F.lit("table"), F.col("table_index")).alias("id")).distinct()
    assert [r["id"] for r in short.collect()] == ["3e126592bfff"]
    equations = X.with_element_ids(spark.createDataFrame([], "paper_id string, page_number int, eq_index int, latex string, source string"), "equation", "eq_index")
    figures = X.with_element_ids(spark.createDataFrame([], "paper_id string, page_number int, i int, element_type string, fig_number string, content string, image_path string"), "figure", "i")
    g = G.build_graph(spark, "Topic", papers, texts, X.with_element_ids(told, "table", "table_index"), equations, figures)
    held = g.edge("HAS_TABLE").join(g.node("Table"), F.col("dst") == F.col("element_id")).select("src", "paper_id", "content", "is_benchmark")
    assert sorted(map(tuple, held.collect())) == [("1344792", "1344792", "u", False), ("4285960", "4285960", "t", True)]


def test_merge_keeps_the_last_value_that_is_not_null(spark):
    w = spark.createDataFrame([("m", None, "a", 1), ("m", True, None, 2), ("m", None, "b", 3), ("m", None, None, 4), ("", None, "z", 5)], "name string, from_table boolean, kind string, seq int")
    assert [tuple(r) for r in G.merge_nodes(w, "Method", ["seq"]).collect()] == [("m", True, "b")]


def test_edges_need_both_ends(spark):
    g = toy(spark)
    w = spark.createDataFrame([("1", "COCO"), ("1", "COCO"), ("7", "COCO"), ("1", "nowhere")], "src string, dst string")
    assert [tuple(r) for r in G.merge_edges(w, "USES_DATASET", g).collect()] == [("1", "COCO")]


def test_upsert_and_clear(spark):
    g = toy(spark)
    u = G.upsert(g, "Method", spark.createDataFrame([("BERT", True), ("new", None)], "name string, from_table boolean"))
    assert u.node("Method").count() == 21
    assert u.node("Method").where("name = 'BERT'").first()["from_table"]
    with pytest.raises(ValueError):
        g.clear()
    assert g.clear(confirm=True).nodes == {}


def test_branches_equal_the_naive_join(spark, sf_dir):
    """The context query against joins that multiply and collect distinctly, and its plan without nested loops."""
    g = testbed.star_graph(spark, sf_dir)
    got = named(g, "context_all_papers", limit=10)
    p = g.node("Paper").orderBy(F.desc("published"), "arxiv_id").limit(10)
    e = lambda k, a: g.edge(k).select(F.col("src").alias(f"{a}s"), F.col("dst").alias(f"{a}d"))
    naive = p.join(e("PROPOSES", "m"), F.col("ms") == F.col("arxiv_id"), "left").join(e("USES_DATASET", "u"), F.col("us") == F.col("arxiv_id"), "left").join(e("WROTE", "w"), F.col("wd") == F.col("arxiv_id"), "left")
    want = naive.groupBy("arxiv_id").agg(F.array_sort(F.collect_set("md")).alias("methods"), F.array_sort(F.collect_set("ud")).alias("datasets"), F.array_sort(F.collect_set("ws")).alias("authors"))
    rows = lambda d: {r["arxiv_id"]: (r["methods"], r["datasets"], r["authors"]) for r in d.collect()}
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_named_queries_equal_the_language(spark):
    g = toy(spark)
    rows = lambda d: [r.asDict() for r in d.collect()]
    for name, text, params in (
        ("papers_by_author", "MATCH (a:Author {name: $author})-[:WROTE]->(p:Paper) RETURN p.arxiv_id AS arxiv_id, p.title AS title, p.published AS published ORDER BY p.published DESC", {"author": "Ann"}),
        ("context_for_topic", "MATCH (t:Topic {name: $topic})-[:INCLUDES]->(p:Paper) OPTIONAL MATCH (p)-[:PROPOSES]->(m:Method) OPTIONAL MATCH (p)-[:USES_DATASET]->(d:Dataset) OPTIONAL MATCH (a:Author)-[:WROTE]->(p) RETURN p.arxiv_id AS arxiv_id, p.title AS title, p.abstract AS abstract, collect(DISTINCT m.name) AS methods, collect(DISTINCT d.name) AS datasets, collect(DISTINCT a.name) AS authors ORDER BY p.published DESC LIMIT $limit", {"topic": "my topic", "limit": 5}),
        ("all_topics", "MATCH (t:Topic) OPTIONAL MATCH (t)-[:INCLUDES]->(p:Paper) RETURN t.name AS topic, count(p) AS paper_count ORDER BY paper_count DESC", {}),
        ("relationship_stats", "MATCH ()-[r]->() RETURN type(r) AS relationship, count(r) AS count ORDER BY count DESC", {}),
    ):
        assert rows(named(g, name, **params)) == rows(query(g, text, **params)), name
    assert set(CATALOG) >= {"papers_by_topic", "datasets_for_method", "rich_figures"}


@pytest.mark.parametrize("text", ["MATCH (n", "MATCH (a:Paper) RETURN sum(a.x)", "MATCH (a:Paper) RETURN a.x LIMIT $n", "MATCH (a:Nothing) RETURN a.x", "MATCH (a:Paper) RETURN a.x AS x nonsense"])
def test_bad_queries_say_so(spark, text):
    with pytest.raises(ValueError):
        query(G.Graph(spark), text).collect()


def test_nulls_count_as_greatest(spark):
    g = G.Graph(spark, {"Paper": spark.createDataFrame([("1", None), ("2", "b"), ("3", "a")], "arxiv_id string, published string")})
    ids = lambda q: [r[0] for r in query(g, q).collect()]
    assert ids("MATCH (p:Paper) RETURN p.arxiv_id AS i ORDER BY p.published DESC") == ["1", "2", "3"]
    assert ids("MATCH (p:Paper) RETURN p.arxiv_id AS i ORDER BY p.published") == ["3", "2", "1"]


def test_optional_count_keeps_zero(spark):
    g = toy(spark)
    g.nodes["Topic"] = g.node("Topic").unionByName(spark.createDataFrame([("empty", "Empty")], "name string, display_name string"))
    assert {r["topic"]: r["paper_count"] for r in named(g, "all_topics").collect()} == {"my topic": 2, "empty": 0}


def test_limit_comes_before_branches(spark, sf_dir):
    q = CATALOG["context_for_topic"](topic="nation_3", limit=3)
    assert pattern.run(testbed.star_graph(spark, sf_dir), q).count() == 3


def test_ask_and_rich(spark):
    g = toy(spark)
    got = ask(g, "accuracy numbers", model=lambda p: f"{len(p) > 0}")
    assert got["query_type"] == "table" and got["answer"] == "True" and got["sources"] == ["A"]
    assert "Title: B" in ask(g, "hello")["context"]
    assert rich_content(g, "show the table")[1].count() == 1
    assert rich_content(g, "hello") == ("text", None)
    stats = graph_stats(g).first()
    assert stats["all_label"] == 30 and stats["by_type"]["WROTE"] == 3


def test_graph_round_trip(spark, tmp_path):
    g = toy(spark)
    sinks.write_graph(g, str(tmp_path))
    again = sinks.read_graph(spark, str(tmp_path), list(g.nodes), list(g.edges))
    assert counts(again) == counts(g)


def test_ask_tells_the_source_of_every_row(spark):
    n = 130
    papers = spark.createDataFrame([(f"{i:03}", f"T{n - i}", "abc", "2024", None, "cs", []) for i in range(n)], "arxiv_id string, title string, abstract string, published string, pdf_url string, primary_category string, authors array<string>")
    texts = spark.createDataFrame([], "paper_id string, entities map<string,array<string>>")
    told = [(f"{i:03}", 1, k, "t", 2, 1, True, ["Method", "F1"], [["x", "9"]]) for i in range(n) for k in range(1 + (i == 0))]
    tables = X.with_element_ids(spark.createDataFrame(told, "paper_id string, page_number int, table_index int, content string, col_count int, row_count int, is_benchmark boolean, headers array<string>, rows array<array<string>>"), "table", "table_index")
    equations = X.with_element_ids(spark.createDataFrame([], "paper_id string, page_number int, eq_index int, latex string, source string"), "equation", "eq_index")
    figures = X.with_element_ids(spark.createDataFrame([], "paper_id string, page_number int, i int, element_type string, fig_number string, content string, image_path string"), "figure", "i")
    got = ask(G.build_graph(spark, "Topic", papers, texts, tables, equations, figures), "accuracy numbers")
    assert got["sources"] == ["T130", *[f"T{n - i}" for i in range(n)]]
    assert got["context"].count("PAPER ") == n + 1


def test_json_sources(spark, tmp_path):
    paper = {"arxiv_id": "1", "title": "a\nb ", "authors": ["x"], "abstract": " c"}
    (tmp_path / "list.json").write_text(json.dumps([paper]))
    (tmp_path / "batch.json").write_text(json.dumps({"count": 1, "papers": [paper | {"arxiv_id": "2"}]}))
    assert sources.read_search_cache(spark, str(tmp_path / "list.json")).count() == 1
    both = sources.read_batch(spark, str(tmp_path))
    assert sorted(r["arxiv_id"] for r in both.collect()) == ["1", "2"]
    clean = sources.clean_records(sources.fetch_by_id(both, "1")).first()
    assert (clean["title"], clean["abstract"]) == ("a b", "c")
    doc = json.loads(sinks.search_batch(both, "now").first()["value"])
    assert doc["count"] == 2 and [p["arxiv_id"] for p in doc["papers"]] == ["1", "2"]
    folder = tmp_path / "x" / "1"
    folder.mkdir(parents=True)
    (folder / "extraction.json").write_text(json.dumps({"paper_id": "1", "pdf_path": "p", "elements": [{"element_type": "text", "content": "c", "paper_id": "1"}]}))
    (tmp_path / "x" / "extraction.json").write_text("{broken")
    assert [r["paper_id"] for r in sources.read_extractions(spark, str(tmp_path / "x")).collect()] == ["1"]


def test_pdf_sources(spark, tmp_path):
    (tmp_path / "1.pdf").write_bytes(b"%PDF-" + b"x" * 10_000)
    (tmp_path / "2.pdf").write_bytes(b"%PDF-")
    files = sources.read_pdfs(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    assert sinks.pdf_report(files).first()["files"] == 1
    papers = spark.createDataFrame([("1.pdf",), ("2.pdf",), ("3.pdf",)], "pdf_name string")
    told = sources.download_status(papers, files)
    assert {r["pdf_name"]: r["download_status"] for r in told.collect()} == {"1.pdf": "downloaded", "2.pdf": "failed", "3.pdf": "pending"}


def test_route_inputs(spark):
    df = spark.createDataFrame([("", "7", None, "a.pdf", "downloaded"), ("p", "8", "b.pdf", None, "failed"), (None, "", "c.pdf", None, "downloaded")], "paper_id string, arxiv_id string, pdf_path string, local_pdf_path string, download_status string")
    assert sorted(map(tuple, X.route_inputs(df).collect())) == [("7", "a.pdf"), ("unknown", "c.pdf")]


def test_stream_merges_and_replays(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "name string, from_table boolean"
    for rows in ([("a", None), ("b", True)], [("a", True), ("c", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        streaming.stream_nodes(spark.readStream.schema(schema).json(src), "Method", out, ck).awaitTermination()
    got = {r["name"]: r["from_table"] for r in streaming.read_nodes(spark, out).collect()}
    assert got == {"a": True, "b": True, "c": None}


def test_evaluated_on_option(spark):
    t = spark.createDataFrame([("1", True, ["Method", "COCO mAP"], [["BERT", "1"], ["ViT", "2"]]), ("1", True, ["Method", "F1"], [["GPT", "1"]])], "paper_id string, is_benchmark boolean, headers array<string>, rows array<array<string>>")
    assert sorted(map(tuple, G.evaluated_on(t).collect())) == [("BERT", "COCO"), ("ViT", "COCO")]


def test_settings(monkeypatch):
    from quillgraph.settings import Settings

    monkeypatch.setenv("QUILLGRAPH_ARXIV_MAX_RESULTS", "20")
    assert Settings.from_env().arxiv_max_results == 20
    for bad in ({"arxiv_max_results": 0}, {"request_delay": 0.1}, {"context_papers": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)
