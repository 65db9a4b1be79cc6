"""Question routing, retrieval and context building."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..plans.catalog import named
from .graph import Graph

# Kinds of questions and the words that tell them, in the order in which they are tried.
QUESTION_WORDS = (
    ("dataset", ("dataset", "trained on", "evaluated on", "benchmark")),
    ("equation", ("equation", "formula", "math", "defined", "attention score")),
    ("table", ("table", "results", "performance", "accuracy", "score", "comparison")),
    ("figure", ("figure", "diagram", "architecture", "image", "visualization")),
    ("author", ("author", "who wrote", "researcher", "proposed by")),
    ("method", ("method", "model", "approach", "technique", "algorithm")),
)
RICH_WORDS = (
    ("figure", ("figure", "image", "diagram", "architecture", "picture", "visual", "illustration")),
    ("table", ("table", "benchmark", "results", "performance", "accuracy", "comparison")),
    ("equation", ("equation", "formula", "math", "latex", "expression")),
)
NOTHING_FOUND = "No relevant information found in the knowledge graph."


def _first_of(question: Column, words, other: str) -> Column:
    q = F.lower(question)
    return reduce(lambda c, w: c.when(any_of(q, w[1]), w[0]), words[1:], F.when(any_of(q, words[0][1]), words[0][0])).otherwise(other)


def query_type(question: Column) -> Column:
    """R1."""
    return _first_of(question, QUESTION_WORDS, "general")


def rich_type(question: Column) -> Column:
    """R2."""
    return _first_of(question, RICH_WORDS, "text")


def _kind(spark, question: str, of: Callable[[Column], Column]) -> str:
    return spark.range(1).select(of(F.lit(question)).alias("k")).first()["k"]


def retrieve(graph: Graph, question: str, limit: int = 10, most_tables: int = 1_000) -> DataFrame:
    """Benchmark tables for a question about tables if there are any, else the context of the latest papers.

    most_tables: how many tables a context takes, those of the latest papers first, as a context is one text on the driver.
    """
    if _kind(graph.spark, question, query_type) == "table":
        tables = named(graph, "benchmark_tables", limit=most_tables)
        if not tables.isEmpty():
            return tables
    return named(graph, "context_all_papers", limit=limit)


def rich_content(graph: Graph, question: str) -> tuple[str, DataFrame | None]:
    """The kind of content a question asks for, and its rows."""
    kind = _kind(graph.spark, question, rich_type)
    name = {"figure": "rich_figures", "table": "rich_tables", "equation": "rich_equations"}.get(kind)
    return kind, named(graph, name) if name else None


def context_lines(rows: DataFrame, order: list[Column]) -> DataFrame:
    """(rank, context, source) with one text per row. Fields that are missing or empty leave no line."""
    have = set(rows.columns)
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in have else F.lit(None).cast("string")
    full = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")) if c in have else F.array().cast("array<string>")

    def said(before: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(before), value))

    def listed(before: str, c: str, sep: str, items: Callable[[Column], Column] = lambda a: a) -> Column:
        return F.when(F.size(full(c)) > 0, F.concat(F.lit(before), F.array_join(items(full(c)), sep)))

    # The labels of a context's lines.
    rule = "=" * 50
    rank = F.row_number().over(Window.orderBy(*order))
    ranked = rows.withColumn("rank", rank)
    parts = [
        F.lit("\n" + rule), F.concat(F.lit("PAPER "), F.col("rank").cast("string")), F.lit(rule),
        said("Title: ", text("title")), said("ArXiv ID: ", text("arxiv_id")), said("Published: ", F.substring(text("published"), 1, 10)), listed("Authors: ", "authors", ", "),
        said("\nAbstract:\n", text("abstract")), listed("\nProposed Methods/Models: ", "methods", ", "), listed("Datasets Used: ", "datasets", ", "),
        listed("\nKey Equations:\n", "equations", "\n", lambda a: F.transform(a, lambda x: F.concat(F.lit("  - "), x))),
        listed("\nTables/Results:\n", "tables", "\n", lambda a: F.transform(a, lambda x: F.substring(x, 1, 600))),
        listed("\nFigures: ", "figure_captions", " | ", lambda a: F.slice(a, 1, 5)), listed("Key Concepts: ", "concepts", ", "),
    ]
    return ranked.select("rank", F.concat_ws("\n", *parts).alias("context"), F.coalesce(text("title"), text("arxiv_id"), F.lit("Unknown")).alias("source"))


def _context_and_sources(rows: DataFrame, order: list[Column]) -> tuple[str, list[str]]:
    found = context_lines(rows, order).orderBy("rank").collect()
    return "\n".join(r["context"] for r in found) if found else NOTHING_FOUND, [r["source"] for r in found]


def context_string(rows: DataFrame, order: list[Column]) -> str:
    """R4 on the driver, for the few rows that a context query returns."""
    return _context_and_sources(rows, order)[0]


def prompt(context: str, question: str) -> str:
    """R5."""
    return f"Answer from this excerpt of a knowledge graph and from nothing else.\n\n{context}\n\nQuestion: {question}\nAnswer:"


def ask(graph: Graph, question: str, model: Callable[[str], str] | None = None, limit: int = 10) -> dict:
    """Retrieval, context and, if a model is given, its answer. sources: one for each row of the context, in its order."""
    rows = retrieve(graph, question, limit)
    order = [F.desc_nulls_first("published")] if "published" in rows.columns else []
    context, told = _context_and_sources(rows, [*order, F.asc_nulls_last("arxiv_id")])
    return {"answer": model(prompt(context, question)) if model else None, "context": context, "query_type": _kind(graph.spark, question, query_type), "sources": told}


def reparse_table(content: Column, headers: Column, keep_empty: bool = False) -> Column:
    """Rows of cells for display, padded to the widest. keep_empty: empty cells keep their column, and the header line isn't repeated."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("---")))
    cells = lambda x: F.transform(F.split(x, r"\|", -1), lambda c: F.trim(c))
    if keep_empty:
        rows = F.transform(F.filter(lines, lambda x: x != F.array_join(headers, " | ")), cells)
    else:
        rows = F.filter(F.transform(lines, lambda x: F.filter(cells(x), lambda c: c != "")), lambda r: F.size(r) > 0)
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def first_seen_groups(rows: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """(place, key, values) with groups and their values in the order in which they are first seen. For the few rows of a result page."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    groups = numbered.groupBy(key).agg(F.min("_n").alias("_first"), F.sort_array(F.collect_list(F.struct("_n", value))).alias("_rows"))
    return groups.select(F.row_number().over(Window.orderBy("_first")).alias("place"), key, F.transform("_rows", lambda r: r[value]).alias("values"))


def answer_parts(answer: Column) -> Column:
    """The parts of an answer as struct(latex, text): bracketed stretches that hold formulas, and what is between them."""
    piece = r"\\\[[\s\S]*?\\\]|\[[^\[\]]{8,}?\]|(?:(?!\\\[[\s\S]*?\\\]|\[[^\[\]]{8,}?\])[\s\S])+"
    is_latex = lambda p: p.rlike(r"^\\\[[\s\S]*\\\]$") | (p.rlike(r"^\[[\s\S]{8,}\]$") & p.rlike(r"[\\^_{}]"))
    return F.transform(F.regexp_extract_all(answer, F.lit(piece), F.lit(0)), lambda p: F.struct(is_latex(p).alias("latex"), p.alias("text")))


def graph_stats(graph: Graph) -> DataFrame:
    """One row with counts by label and type, and totals."""
    n, r = named(graph, "graph_stats").select(F.lit("label").alias("k"), F.col("label").alias("name"), "count"), named(graph, "type_stats").select(F.lit("type"), "type", "count")
    of = lambda k: F.col("k") == k
    told = lambda k: F.map_from_entries(F.sort_array(F.collect_list(F.when(of(k), F.struct("name", "count"))))).alias(f"by_{k}")
    total = lambda k: F.coalesce(F.sum(F.when(of(k), F.col("count"))), F.lit(0)).alias(f"all_{k}")
    return n.union(r).agg(told("label"), total("label"), told("type"), total("type"))
