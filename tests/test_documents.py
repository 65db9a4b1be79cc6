"""Queries over the lines of all documents, whatever their script, against plain Python."""

import re
from collections import Counter

from quillgraph.functions import text as T
from quillgraph.queries import QUERIES

TEXTS = [
    "plain accuracy line\n\nF1 score and mAP",
    "La precisión es buena: accuracy, éaccuracy y recall aquí\nséptimo año",
    "精度 precision 日本語　二つ\n精度accuracy BLEU-4。recall",
    "größer als \x1cLatenz latencý ½recall IS iS ıs\r\nFPS\u0085PSNR",
    "",
    None,
    "á mAP\n",
]


def plain(rows):
    lines = [(str(i), k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    words = sorted((i, k, len(line.split())) for i, k, line in lines)
    held = Counter()
    papers = {}
    for i, _, line in lines:
        for name in {m.group().strip() for m in re.finditer(T.mention_pattern(T.METRICS), line, re.I)}:
            if len(name) > 1:
                held[name] += 1
                papers.setdefault(name, set()).add(i)
    return words, sorted((name, n, len(papers[name])) for name, n in held.items())


def test_documents_of_all_scripts(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words, mentions = plain(rows)
    assert sorted(map(tuple, QUERIES["word_counts"](spark, str(tmp_path)).collect())) == words
    assert sorted(map(tuple, QUERIES["document_metric_mentions"](spark, str(tmp_path)).collect())) == mentions


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words, mentions = plain(rows)
    assert sorted(map(tuple, QUERIES["word_counts"](spark, sf_dir).collect())) == words
    assert sorted(map(tuple, QUERIES["document_metric_mentions"](spark, sf_dir).collect())) == mentions


def test_tables_of_pages(spark, tmp_path):
    html = "<html><p>text</p><table><tr><th>Model</th><th>F1</th></tr><tr><td>é</td><td>9</td></tr><tr><td>b</td><td></td></tr></table></html>"
    pages = [(1, html), (2, "<p>no table</p>"), (3, None), (4, "<table><tr><td>x</td><td>1</td></tr></table>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, QUERIES["page_tables"](spark, str(tmp_path)).collect())) == [(1, "Model|F1", "é|9\nb|"), (4, "", "x|1")]
