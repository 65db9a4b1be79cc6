"""Extraction operators: from lines, tables, equations, images and captions to typed elements.

All of them are narrow but for the windows, which run within one paper, and the band join of captions.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from html import unescape
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines_of(pages: DataFrame, text: str = "text") -> DataFrame:
    """the classed lines of each page, with their place; lines of less than 3 characters go."""
    rest = [c for c in pages.columns if c != text]
    lines = pages.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("ordinal", "_line")).withColumn("text", T.py_strip(F.col("_line"))).drop("_line")
    return lines.where(F.length("text") >= 3).withColumn("raw_type", T.line_type(F.col("text")))


def flat_table_text(rows: Column) -> Column:
    """The non-empty cells of a table in one line."""
    return F.array_join(F.filter(F.flatten(rows), lambda c: c.isNotNull() & (c != "")), " | ")


def detect_layout(pages: DataFrame, detector: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The given detector's elements; pages that it leaves out, or all without one, by the heuristic."""
    heuristic = lines_of(pages)
    if detector is None:
        return heuristic
    found = detector(pages)
    left = heuristic.join(found.select("paper_id", "page_number").distinct(), ["paper_id", "page_number"], "left_anti")
    return found.select(*heuristic.columns).unionByName(left)


def text_elements(raw: DataFrame, section_mode: str = "grouped", ner: Callable[[Column], Column] | None = None) -> DataFrame:
    """Text elements with section, word count and entities.

    section_mode: "grouped" treats titles apart from text, so that all text is in the section body;
    "document" lets text take the section of the title above it and drops text under references.
    """
    if section_mode not in ("grouped", "document"):
        raise ValueError(section_mode)
    kind = T.raw_type_kind(F.col("raw_type"))
    told = raw.withColumn("text", T.py_strip(F.col("text"))).withColumn("_kind", kind).where(F.col("_kind").isin("text", "title"))
    own = F.when(F.col("_kind") == "title", T.section_of(F.col("text")))
    if section_mode == "document":
        above = Window.partitionBy("paper_id").orderBy("page_number", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
        told = told.withColumn("section", F.coalesce(F.last(own, ignorenulls=True).over(above), F.lit("body")))
        told = told.where((F.col("_kind") == "title") | (F.col("section") != "references"))
    else:
        told = told.withColumn("section", F.coalesce(own, F.lit("body")))
    kept = told.where(T.keeps_text(F.col("text")))
    return kept.select("paper_id", "page_number", "ordinal", F.col("_kind").alias("element_type"), F.col("text").alias("content"), "section", T.word_count(F.col("text")).alias("word_count"), T.entity_map(F.col("text"), ner).alias("entities"))


_quoted = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<mark>/?(?:tr|td|th))(?=[\s/>]){_quoted}>|</?[a-z]{_quoted}>", re.I | re.S)


def parse_html_table(html: str | None) -> list[list[str]]:
    """T1, from the places of the tags of rows and cells.

    A cell's text goes from its opening tag to the next closing one; a closing tag without an opening one of its own repeats
    the cell before it. A row takes in every cell closed before the next row opens, and counts once for each closing
    tag that comes after one of them.
    """
    html, at = html or "", 0
    marks, texts = [], [""]
    for m in _MARKUP.finditer(html):
        texts[-1] += unescape(html[at : m.start()])
        at = m.end()
        if m["mark"]:
            marks.append(m["mark"].lower())
            texts.append("")
    places = lambda *kinds: [i for i, k in enumerate(marks) if k in kinds]
    opened, closed, ended = places("td", "th"), places("/td", "/th"), places("/tr")

    def cell(end: int) -> str:
        k = bisect(opened, end) - 1
        return "".join(texts[opened[k] + 1 : closed[bisect(closed, opened[k])] + 1]).strip() if k >= 0 else ""

    rows = []
    for lo, hi in pairwise([-1, *places("tr"), len(marks)]):
        inside = closed[bisect(closed, lo) : bisect(closed, hi - 1)]
        if inside:
            rows += [[cell(i) for i in inside]] * (bisect(ended, hi - 1) - bisect(ended, inside[0]))
    return rows


def html_rows(html: Column) -> Column:
    """T1 as a column: array<array<string>>."""

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([parse_html_table(h) for h in b], dtype=object)

    parse.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(parse, "array<array<string>>")(html)


def split_header(rows: Column, shorter_than: int = 40, more_rows: bool = True) -> Column:
    """T2 (40 characters, more than one row) and T3 (50, no such test): struct(headers, rows)."""
    first = F.get(rows, F.lit(0))
    plain_number = lambda c: c.rlike(r"(?U)^\d+\.?\d*$")
    looks = F.forall(F.filter(first, lambda c: c != ""), lambda c: (F.length(c) < shorter_than) & ~plain_number(c))
    if more_rows:
        looks &= F.size(rows) > 1
    none = F.array().cast("array<string>")
    headed = F.coalesce((F.size(rows) > 0) & looks, F.lit(False))
    return F.struct(F.when(headed, first).otherwise(none).alias("headers"), F.when(headed, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(F.coalesce(rows, F.array().cast("array<array<string>>"))).alias("rows"))


def is_benchmark(headers: Column, rows: Column, words: str = "substring") -> Column:
    """T4. words: "substring" finds them anywhere in the headers, "word" as whole words."""
    joined = F.lower(F.array_join(headers, " "))
    if words == "word":
        named = joined.rlike(r"\b(" + "|".join(T.BENCHMARK_WORDS) + r")\b")
    else:
        named = T.any_of(joined, T.BENCHMARK_WORDS)
    return (F.size(headers) >= 2) & named & F.exists(F.flatten(rows), lambda c: c.rlike(r"(?U)\d"))


def table_text(headers: Column, rows: Column) -> Column:
    """Headers, a rule and the rows, one a line."""
    line = lambda r: F.array_join(r, " | ")
    width = F.aggregate(headers, F.lit(0), lambda n, h: n + F.length(h) + 3)
    head = F.when(F.size(headers) > 0, F.array(line(headers), F.repeat(F.lit("-"), width))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows, line)), "\n")


def table_elements(html_tables: DataFrame, text_tables: DataFrame) -> DataFrame:
    """Parsed HTML tables (paper_id, page_number, ordinal, rows), and the others of pages that have none; one running index per paper."""
    html = html_tables.where(F.size("rows") > 0).withColumn("source", F.lit("html")).withColumn("t", split_header(F.col("rows")))
    rest = text_tables.where(F.size("rows") >= 2).join(html.select("paper_id", "page_number").distinct(), ["paper_id", "page_number"], "left_anti")
    rest = rest.withColumn("source", F.lit("pdfplumber")).withColumn("t", split_header(F.col("rows"), 50, more_rows=False))
    columns = ["paper_id", "page_number", "ordinal", "source", "t.headers", "t.rows"]
    both = html.select(*columns).unionByName(rest.select(*columns))
    index = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("source") != "html", "page_number", "ordinal"))
    first = F.get("rows", F.lit(0))
    return both.select(
        "paper_id", "page_number", index.alias("table_index"), "source", "headers", "rows",
        F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.coalesce(F.size(first), F.lit(0))).alias("col_count"),
        F.size("rows").alias("row_count"), is_benchmark(F.col("headers"), F.col("rows")).alias("is_benchmark"), table_text(F.col("headers"), F.col("rows")).alias("content"),
    )


def equation_elements(raw: DataFrame, ocr: Column | None = None) -> DataFrame:
    """Q3: equations with their number within the paper, which counts dropped ones too."""
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "ordinal"))
    told = raw.where(T.raw_type_kind(F.col("raw_type")) == "equation").withColumn("eq_index", number)
    told = told.withColumn("e", T.equation_text(T.py_strip(F.col("text")), ocr)).where(F.col("e.latex") != "")
    return told.select("paper_id", "page_number", "eq_index", F.col("e.latex").alias("latex"), F.col("e.source").alias("source"), F.col("text").alias("raw_text"))


def usable_images(images: DataFrame) -> DataFrame:
    """Images of 10,000 pixels or more, counted per paper."""
    counter = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "ordinal"))
    return images.where(F.col("width") * F.col("height") >= 10_000).withColumn("fig_counter", counter)


def with_fallback_images(images: DataFrame, raw: DataFrame) -> DataFrame:
    """G-C5: papers without embedded images take their raw image elements, with size 0."""
    kinds = raw.where(T.raw_type_kind(F.col("raw_type")) == "figure").join(images.select("paper_id").distinct(), "paper_id", "left_anti")
    counter = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "ordinal"))
    made = kinds.select("paper_id", "page_number", "ordinal", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(None).cast("string").alias("image_path"), counter.alias("fig_counter"))
    return images.select(*made.columns).unionByName(made)


def match_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """G-C3: a caption for each image (paper_id, page_number, fig_counter).

    Candidates are the captions (paper_id, page_number, ordinal, text) on the same or a neighbouring page,
    in order: the first, unless a later one's number holds the image's counter as a substring; then
    the last of those.
    """
    near = captions.where(T.is_caption(F.col("text"))).select("paper_id", F.col("page_number").alias("_page"), F.col("ordinal").alias("_ord"), F.col("text").alias("caption"))
    pairs = images.join(near, (images["paper_id"] == near["paper_id"]) & (F.abs(images["page_number"] - F.col("_page")) <= 1), "left").drop(near["paper_id"])
    key = ["paper_id", "fig_counter"]
    first = F.min("_ord").over(Window.partitionBy(*key))
    named = F.contains(F.coalesce(T.caption_number(F.col("caption")), F.lit("")), F.col("fig_counter").cast("string")) & (F.col("_ord") > first)
    picked = pairs.withColumn("_named", named).groupBy(*key).agg(F.max_by("caption", F.when(F.col("_named"), F.col("_ord"))).alias("_late"), F.min_by("caption", "_ord").alias("_early"))
    return images.join(picked, key, "left").withColumn("caption", F.coalesce("_late", "_early")).drop("_late", "_early")


def figure_elements(images: DataFrame, captions: DataFrame) -> DataFrame:
    """G-C4, G-C6: figures with label and content, and the captions that no figure took."""
    matched = match_captions(images, captions)
    figures = matched.select(
        "paper_id", "page_number", F.lit("figure").alias("element_type"), F.coalesce(T.caption_number(F.col("caption")), F.concat(F.lit("Figure "), F.col("fig_counter").cast("string"))).alias("fig_number"),
        F.coalesce("caption", F.format_string("[Figure %d on page %d]", F.col("fig_counter").cast("int"), F.col("page_number").cast("int"))).alias("content"), F.lit(False).alias("unmatched"),
    )
    taken = matched.where("caption IS NOT NULL").select("paper_id", F.col("caption").alias("text")).distinct()
    left = captions.join(taken, ["paper_id", "text"], "left_anti")
    loose = left.select("paper_id", "page_number", F.lit("caption").alias("element_type"), T.caption_number(F.col("text")).alias("fig_number"), F.col("text").alias("content"), F.lit(True).alias("unmatched"))
    return figures.unionByName(loose)


def element_stats(elements: DataFrame) -> DataFrame:
    """How many elements with content each paper has of each kind."""
    return elements.where(F.length(T.py_strip(F.col("content"))) > 0).groupBy("paper_id", "element_type").agg(F.count("*").alias("n"))


def element_summary(elements: DataFrame) -> DataFrame:
    """One line of counts for each paper, such as 'table: 2, text: 5'."""
    said = F.concat(F.col("element_type"), F.lit(": "), F.col("n").cast("string"))
    return element_stats(elements).groupBy("paper_id").agg(F.array_join(F.sort_array(F.collect_list(said)), ", ").alias("summary"))  # a text for each kind


def raw_type_counts(raw: DataFrame) -> DataFrame:
    """Raw types, the most common first."""
    return raw.groupBy("raw_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw_type")


def route_inputs(papers: DataFrame) -> DataFrame:
    """id and path of each paper that can be extracted."""
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs if c in papers.columns])
    told = papers.withColumn("_id", F.coalesce(filled("paper_id", "arxiv_id"), F.lit("unknown"))).withColumn("_path", filled("pdf_path", "local_pdf_path"))
    if "download_status" in papers.columns:
        told = told.where(F.col("download_status") == "downloaded")
    return told.where(F.col("_path").isNotNull()).select(F.col("_id").alias("paper_id"), F.col("_path").alias("pdf_path"))


def with_element_ids(elements: DataFrame, kind: str, ordinal: str) -> DataFrame:
    """The element's place itself as its key, so that a second run makes the same nodes and no two elements share one; a numeric ordinal keeps the parts apart."""
    return elements.withColumn("element_id", F.concat_ws("|", "paper_id", F.lit(kind), F.col(ordinal).cast("string")))
