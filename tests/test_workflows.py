"""Routing with failures, stored graphs and their report, and bounds."""

import pytest

from quillgraph import testbed
from quillgraph.cli import report
from quillgraph.operators import graph as G
from quillgraph.operators import router
from quillgraph.operators.routing import retrieve
from quillgraph.sources import sinks
from quillgraph.sources.shared import shared_dir

RAW = "paper_id string, page_number int, ordinal int, text string, raw_type string"


def raw(spark):
    rows = [("1", 1, 1, "Introduction to things", "Title"), ("1", 1, 2, "A sentence that is long enough.", "NarrativeText"), ("1", 2, 3, "x = y", "Formula"), ("1", 2, 4, "Figure 1: view", "FigureCaption"), ("1", 2, 5, "7", "PageNumber"), ("1", 2, 6, "?", "Sketch")]
    return spark.createDataFrame(rows, RAW)


def test_every_kind_goes_to_its_extractor(spark, tmp_path):
    got = router.route_elements(raw(spark), str(tmp_path))
    assert sorted((r["element_type"], r["content"]) for r in got.elements.collect()) == [("caption", "Figure 1: view"), ("equation", "x = y"), ("text", "A sentence that is long enough."), ("title", "Introduction to things")]
    assert got.errors == [] and {r["kind"]: r["n"] for r in got.left.collect()} == {"skip": 1}


@pytest.mark.parametrize("late", [False, True])
def test_one_failure_leaves_the_others(spark, tmp_path, late):
    def broken(df):
        if not late:
            raise KeyError("gone")
        return df.selectExpr("paper_id", "raise_error('gone') AS content", "'equation' AS element_type", "page_number")

    got = router.route_elements(raw(spark), str(tmp_path), router.EXTRACTORS | {("equation",): broken})
    assert len(got.errors) == 1 and got.errors[0].startswith("equation: ")
    assert sorted(r["element_type"] for r in got.elements.collect()) == ["caption", "text", "title"]


def test_tables_with_markup(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1, 1, "", "Table", "<table><tr><td>Model</td><td>F1</td></tr><tr><td>a</td><td>9</td></tr></table>"), ("1", 1, 2, "", "Table", None)], RAW + ", html string")
    assert [r["content"] for r in router.route_elements(rows, str(tmp_path)).elements.collect()] == ["Model | F1\n" + "-" * 13 + "\na | 9"]


def test_nothing_to_route(spark, tmp_path):
    got = router.route_elements(raw(spark).limit(0), str(tmp_path))
    assert got.elements.collect() == [] and got.errors == [] and got.left.collect() == []


def test_report_of_papers(spark):
    papers = spark.createDataFrame([("a", None, "p", None), ("", "b", "", "q"), (None, None, None, None)], "paper_id string, arxiv_id string, pdf_path string, local_pdf_path string")
    assert sorted(map(tuple, router.route_report(papers).collect()), key=repr) == [("a", "p", "routed"), ("b", "q", "routed"), ("unknown", None, "no path")]
    files = spark.createDataFrame([("q",), ("q",)], "path string")
    assert {r["paper_id"]: r["status"] for r in router.route_report(papers, files).collect()} == {"a": "missing file", "b": "routed", "unknown": "no path"}


def test_report_of_a_stored_graph(spark, sf_dir, tmp_path):
    g = testbed.star_graph(spark, sf_dir)
    sinks.write_graph(G.Graph(spark, {"Topic": g.node("Topic"), "Paper": g.node("Paper")}, {"INCLUDES": g.edge("INCLUDES")}), str(tmp_path))
    lines = report(spark, str(tmp_path)).split("\n")
    assert "  Topic: 25" in lines and any(x.startswith("  INCLUDES: ") for x in lines) and lines[-26] == "Topics"


def test_tables_of_a_context_are_bounded(spark, sf_dir):
    g = testbed.star_graph(spark, sf_dir)
    assert retrieve(g, "accuracy numbers", most_tables=5).count() == 5


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_dir(Cluster)
