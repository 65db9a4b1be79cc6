"""Text rules on literal rows, and against Python's re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import naming as N
from quillgraph.functions import text as T
from quillgraph.operators.routing import NOTHING_FOUND, answer_parts, context_string, query_type, rich_type


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(("line", "want"), [("Table 3", "FigureCaption"), ("1. Introduction", "Title"), ("Results = 5", "Title"), ("y = 5", "Formula"), ("hello world", "NarrativeText"), (r"\frac{a}", "Formula"), ("x" * 200 + "=", "NarrativeText")])
def test_line_type(spark, line, want):
    assert values(spark, [line], T.line_type) == [want]


def test_keeps_text(spark):
    rows = ["References", "1. Introduction and more", "[12] Smith et al 2020", "A long enough line"]
    assert values(spark, rows, T.keeps_text) == [False, False, False, True]


def test_sections(spark):
    assert values(spark, ["Proposed results", "Related work and references", "Acknowledgements"], T.section_of) == ["methodology", "related_work", "body"]


@pytest.mark.parametrize(
    ("names", "longer", "line", "want"),
    [
        (T.DATASETS, 2, "ImageNet-1K and ImageNet1K; MS COCO, a pile", ["ImageNet", "ImageNet1K", "MS COCO", "pile"]),
        (T.METRICS, 1, "top-1 accuracy is high; it Is AP50", ["AP50", "Is", "is", "top-1 accuracy"]),
        (T.METHODS, 2, "T5 and ResNet-50 with GPT is", ["GPT", "ResNet-50"]),
    ],
)
def test_mentions(spark, names, longer, line, want):
    assert values(spark, [line], lambda c: T.mentions(c, names, longer)) == [want]


def test_mentions_equal_python(spark):
    rnd = random.Random(5)
    pieces = ["BERT", "bert-", "ViT", "Swin B", "GPT-4", "is", "é", " ", "\r", " ", "\n", "mAP", "AP@50", "IoU.", "İS", "COCO", "cc12M", "VOC 2007", "dilated x Attention", "-", "_", "1K", "²"]
    lines = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", ","]) for _ in range(12)) for _ in range(400)]
    for names, longer in ((T.DATASETS, 2), (T.METHODS, 2), (T.METRICS, 1)):
        p = re.compile(T.mention_pattern(names), re.I)
        want = [sorted({s for s in (m.group(0).strip() for m in p.finditer(x)) if len(s) > longer}) for x in lines]
        assert values(spark, lines, lambda c, n=names, k=longer: T.mentions(c, n, k)) == want


def test_captions(spark):
    yes = ["Figure 3: x", "Fig. 5a. y", "Table 5 res", "Figure1. An", "FIGURE 12B x"]
    assert values(spark, [*yes, "Table5. r", "Figure 3", "Figures 3 x"], T.is_caption) == [True] * 5 + [False] * 3
    assert values(spark, ["FIGURE 3: x", "fig. 5a x", "Table5. r", "plain"], T.caption_number) == ["Figure 3", "Fig. 5a", "Table 5", None]


def test_equation_text(spark):
    got = values(spark, ["a   b", "x_{i}   y", "\frac12"], T.equation_text)
    assert [tuple(r) for r in got] == [("a b", "raw_text"), ("x_{i}   y", "latex_hint"), ("\frac12", "latex_hint")]


def test_routing(spark):
    rows = ["Show me the benchmark results", "attention score?", "accuracy numbers", "show figures", "Which authors wrote these papers?", "What methods are proposed", "are they undefined", "Summarise the contributions"]
    assert values(spark, rows, query_type) == ["dataset", "equation", "table", "figure", "author", "method", "equation", "general"]
    assert values(spark, ["Show me the benchmark results", "show figures", "latex please", "hello"], rich_type) == ["table", "figure", "equation", "text"]


def test_context_of_nothing_and_of_a_title(spark):
    empty = spark.createDataFrame([], "title string")
    assert context_string(empty, [F.col("title")]) == NOTHING_FOUND
    one = spark.createDataFrame([("A",)], "title string")
    rule = "=" * 50
    assert context_string(one, [F.col("title")]) == f"\n{rule}\nPAPER 1\n{rule}\nTitle: A"


def test_cache_key(spark):
    got = spark.range(1).select(N.cache_key(F.lit("transformer attention"), F.lit(3)), N.cache_key(F.lit("transformers"), F.lit(3))).first()
    assert list(got) == ["transformer_attention_af3dbe604e.json", "transformers_5e6aafcef9.json"]


def test_names(spark):
    got = spark.range(1).select(N.sidecar("table", F.lit(7), F.lit(2)), N.pdf_filename(F.lit("a/b")), N.ellipsis(F.lit("abc"), 2), N.box_of(F.array(F.lit(3.0), F.lit(1.0)), F.array(F.lit(5.0), F.lit(9.0)))).first()
    assert list(got) == ["table_007_p2.json", "a_b.pdf", "ab…", [1.0, 5.0, 3.0, 9.0]]


def test_crop_box(spark):
    df = spark.createDataFrame([([10.0, 10.0, 20.0, 20.0],), ([90.0, 90.0, 50.0, 50.0],)], "b array<double>")
    got = [r[0] for r in df.select(N.crop_box(F.col("b"), F.lit(72.0), F.lit(72.0))).collect()]
    assert tuple(got[0]) == (17, 17, 65, 65)
    assert got[1] is None


def test_answer_parts(spark):
    got = values(spark, [r"so \[a^2\] and [x_{1} + y^2] see [12]"], answer_parts)[0]
    assert [(p["latex"], p["text"]) for p in got] == [(False, "so "), (True, r"\[a^2\]"), (False, " and "), (True, "[x_{1} + y^2]"), (False, " see [12]")]


def test_pdf_validity(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-" + b"x" * 10_000),), (bytearray(b"%PDF-"),), (bytearray(b"y" * 10_001),), (None,)], "c binary")
    assert [r[0] for r in df.select(N.valid_pdf(F.col("c"))).collect()] == [True, False, False, False]
