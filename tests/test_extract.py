"""Extraction operators on literal rows."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import extract as X
from quillgraph.operators.routing import reparse_table


def headers_rows(spark, rows, **kw):
    r = spark.createDataFrame([(rows,)], "r array<array<string>>").select(X.split_header(F.col("r"), **kw).alias("t")).first()["t"]
    return r["headers"], r["rows"]


def test_header_rules(spark):
    assert headers_rows(spark, [["", ""], ["1", "2"]]) == (["", ""], [["1", "2"]])
    assert headers_rows(spark, [["Model", "Acc"]]) == ([], [["Model", "Acc"]])
    assert headers_rows(spark, [["1", "2"], ["3", "4"]]) == ([], [["1", "2"], ["3", "4"]])
    assert headers_rows(spark, [["Model" * 9], ["3"]], shorter_than=50, more_rows=False) == (["Model" * 9], [["3"]])


def test_benchmark_and_text(spark):
    df = spark.createDataFrame([(["Method", "Mapping"], [["a", "1"]]), (["Model", "Accuracy"], [["a", "b"]]), (["Accuracy"], [["1"]])], "h array<string>, r array<array<string>>")
    assert [r[0] for r in df.select(X.is_benchmark(F.col("h"), F.col("r"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(X.is_benchmark(F.col("h"), F.col("r"), "word")).collect()] == [False, False, False]
    t = spark.createDataFrame([(["Model", "Acc"], [["BERT", "90"]])], "h array<string>, r array<array<string>>")
    assert t.select(X.table_text(F.col("h"), F.col("r"))).first()[0] == "Model | Acc\n" + "-" * 14 + "\nBERT | 90"


def test_html(spark):
    html = "<table><tr><th>A</th><th> B </th></tr><tr><td>1<b>x</b></td><td></td></tr><tr><td>lost"
    assert X.parse_html_table(html) == [["A", "B"], ["1x", ""]]
    odd = """<TABLE><!-- <tr><td>no</td></tr> --><tr class="a>b"><td title='x>y'>a&amp;b<br>c</TD><th>d</th></tr><tr></tr><td>e</td><track>f</tr></tr></td>"""
    assert X.parse_html_table(odd) == [["a&bc", "d"], ["e", "e"], ["e", "e"]]
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(X.html_rows(F.col("h"))).collect()] == [[["A", "B"], ["1x", ""]], [], []]


def test_caption_match_literals(spark):
    images = spark.createDataFrame([("p", 1, 1, 1), ("p", 1, 2, 2), ("p", 5, 3, 3)], "paper_id string, page_number int, ordinal int, fig_counter int")
    captions = spark.createDataFrame([("p", 1, 1, "Figure 4: a"), ("p", 1, 2, "Figure 12: b"), ("p", 2, 3, "Figure 2. c")], "paper_id string, page_number int, ordinal int, text string")
    got = {r["fig_counter"]: r["caption"] for r in X.match_captions(images, captions).collect()}
    assert got == {1: "Figure 12: b", 2: "Figure 2. c", 3: None}


def test_caption_match_equals_a_loop(spark):
    rnd = random.Random(2)
    images = [("p", rnd.randint(1, 6), i, i) for i in range(1, 13)]
    captions = [("p", rnd.randint(1, 6), k, f"Figure {rnd.randint(1, 12)}: c{k}") for k in range(20)]
    want = {}
    for _, page, _, n in images:
        best = None
        for _, p, _, text in captions:
            if abs(p - page) <= 1 and (best is None or str(n) in text.split(":")[0]):
                best = text
        want[n] = best
    got = X.match_captions(spark.createDataFrame(images, "paper_id string, page_number int, ordinal int, fig_counter int"), spark.createDataFrame(captions, "paper_id string, page_number int, ordinal int, text string"))
    assert {r["fig_counter"]: r["caption"] for r in got.collect()} == want


def test_sections_carry(spark):
    rows = [("p", 1, 1, "Title", "1 Introduction to things"), ("p", 1, 2, "NarrativeText", "a sentence that is long"), ("p", 1, 3, "Title", "References"), ("p", 1, 4, "NarrativeText", "a dropped long sentence"), ("q", 1, 1, "NarrativeText", "no heading above this")]
    raw = spark.createDataFrame(rows, "paper_id string, page_number int, ordinal int, raw_type string, text string")
    got = {(r["content"], r["section"]) for r in X.text_elements(raw, "document").collect()}
    assert got == {("1 Introduction to things", "introduction"), ("a sentence that is long", "introduction"), ("no heading above this", "body")}
    assert {r["section"] for r in X.text_elements(raw).where("element_type = 'text'").collect()} == {"body"}


def test_figures_and_fallback(spark):
    raw = spark.createDataFrame([("p", 1, 1, "Image", ""), ("q", 1, 1, "Image", "")], "paper_id string, page_number int, ordinal int, raw_type string, text string")
    images = spark.createDataFrame([("p", 1, 1, 200, 100, "f.png"), ("p", 1, 2, 10, 10, "g.png")], "paper_id string, page_number int, ordinal int, width int, height int, image_path string")
    both = X.with_fallback_images(X.usable_images(images), raw)
    assert {(r["paper_id"], r["image_path"], r["fig_counter"]) for r in both.collect()} == {("p", "f.png", 1), ("q", None, 1)}


def test_table_sources(spark):
    schema = "paper_id string, page_number int, ordinal int, rows array<array<string>>"
    html = spark.createDataFrame([("p", 1, 1, [["A", "F1"], ["x", "9"]])], schema)
    other = spark.createDataFrame([("p", 1, 1, [["no"], ["no"]]), ("p", 2, 1, [["A"], ["b"]]), ("p", 2, 2, [["one"]])], schema)
    got = [(r["table_index"], r["source"], r["is_benchmark"], r["row_count"]) for r in X.table_elements(html, other).orderBy("table_index").collect()]
    assert got == [(1, "html", True, 1), (2, "pdfplumber", False, 1)]


def test_reparse(spark):
    t = spark.createDataFrame([("A | B\n-----\n1 |  | 2\nplain", ["A", "B"])], "c string, h array<string>")
    assert t.select(reparse_table(F.col("c"), F.col("h"))).first()[0] == [["A", "B"], ["1", "2"]]
    assert t.select(reparse_table(F.col("c"), F.col("h"), keep_empty=True)).first()[0] == [["1", "", "2"]]


def test_named_entities_hook(spark):
    from quillgraph.functions import text as T

    df = spark.createDataFrame([("BERT by Ann Lee",), ("tiny",)], "t string")
    hook = lambda c: F.create_map(F.lit("persons"), F.array(F.lit(" Ann Lee "), F.lit("x"), F.lit("Ann Lee")), F.lit("orgs"), F.array().cast("array<string>"))
    got = [r[0] for r in df.select(T.entity_map(F.col("t"), hook)).collect()]
    assert got == [{"methods": ["BERT"], "persons": ["Ann Lee"]}, {}]


def test_layout_hook(spark):
    pages = spark.createDataFrame([("p", 1, "a line of text"), ("p", 2, "another line")], "paper_id string, page_number int, text string")
    found = lambda p: X.lines_of(p).where("page_number = 1").withColumn("raw_type", F.lit("Table"))
    assert sorted((r["page_number"], r["raw_type"]) for r in X.detect_layout(pages, found).collect()) == [(1, "Table"), (2, "NarrativeText")]
