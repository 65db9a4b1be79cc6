"""Graph building: nodes and edges are tables, and merging is a set operation that can be repeated."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DATASETS, mentions, py_strip

# The key property of each label, and the labels at both ends of each type of edge.
KEYS = {"Paper": "arxiv_id", "Author": "name", "Method": "name", "Dataset": "name", "Concept": "name", "Topic": "name", "Table": "element_id", "Equation": "element_id", "Figure": "element_id"}
EDGES = {
    "WROTE": ("Author", "Paper"), "INCLUDES": ("Topic", "Paper"), "PROPOSES": ("Paper", "Method"), "USES_DATASET": ("Paper", "Dataset"), "MENTIONS": ("Paper", "Concept"),
    "EVALUATED_ON": ("Method", "Dataset"), "DEFINED_BY": ("Method", "Equation"), "HAS_TABLE": ("Paper", "Table"), "HAS_FIGURE": ("Paper", "Figure"), "HAS_EQUATION": ("Paper", "Equation"), "CITES": ("Paper", "Paper"),
}
#: Properties that stay true once any write set them.
STICKY = ("from_table",)


@dataclass
class Graph:
    """nodes: by label, with the key property; edges: by type, as (src, dst). Missing tables count as empty."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)

    def node(self, label: str) -> DataFrame:
        if label not in KEYS:
            raise ValueError(f"unknown label {label}")
        return self.nodes[label] if label in self.nodes else self.spark.createDataFrame([], f"{KEYS[label]} string")

    def edge(self, kind: str) -> DataFrame:
        if kind not in EDGES:
            raise ValueError(f"unknown type {kind}")
        return self.edges[kind] if kind in self.edges else self.spark.createDataFrame([], "src string, dst string")

    def clear(self, confirm: bool = False) -> Graph:
        """K11."""
        if not confirm:
            raise ValueError("confirm=True is needed to clear the graph")
        return Graph(self.spark)


def merge_nodes(writes: DataFrame, label: str, order: list[str] | None = None) -> DataFrame:
    """G1: one row per key; each property has its latest value that isn't null.

    order: the columns that tell the writes' order; without it any of them counts as latest. Rows with a
    null or empty key are left out.
    """
    key, order = KEYS[label], order or []
    seq = F.struct(*order) if order else None

    def last(c: str) -> Column:
        if c in STICKY:
            return F.bool_or(c)
        return F.first(c, ignorenulls=True) if seq is None else F.max_by(c, F.when(F.col(c).isNotNull(), seq))

    props = [c for c in writes.columns if c != key and c not in order]
    told = writes.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return told.groupBy(key).agg(*[last(c).alias(c) for c in props]) if props else told.select(key).distinct()


def merge_edges(writes: DataFrame, kind: str, graph: Graph) -> DataFrame:
    """Distinct edges of which both ends exist."""
    src, dst = EDGES[kind]
    ends = lambda label, c: graph.node(label).select(F.col(KEYS[label]).alias(c))
    return writes.select("src", "dst").distinct().join(ends(src, "src"), "src", "left_semi").join(ends(dst, "dst"), "dst", "left_semi").select("src", "dst")


def upsert(graph: Graph, label: str, writes: DataFrame) -> Graph:
    """K8: existing nodes and new writes merged, new ones last."""
    old = graph.nodes.get(label)
    new = writes.withColumn("_seq", F.lit(1))
    both = new if old is None else old.withColumn("_seq", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return Graph(graph.spark, graph.nodes | {label: merge_nodes(both, label, ["_seq"])}, graph.edges)


def benchmark_methods(tables: DataFrame) -> DataFrame:
    """(paper_id, name) of the first cells of a benchmark table's first 20 rows, if they have two characters or more."""
    told = tables.where(F.col("is_benchmark") & (F.size("headers") > 0) & (F.size("rows") > 0))
    cells = told.select("paper_id", F.explode(F.slice("rows", 1, 20)).alias("row"))
    return cells.select("paper_id", py_strip(F.get("row", F.lit(0))).alias("name")).where(F.length("name") >= 2)


def evaluated_on(tables: DataFrame) -> DataFrame:
    """An option beyond the code followed: EVALUATED_ON (src, dst) from a benchmark table's methods to the data sets its headers name."""
    named = tables.withColumn("_sets", mentions(F.array_join("headers", " "), DATASETS, 2)).where(F.size("_sets") > 0)
    pairs = benchmark_methods(named.withColumn("paper_id", F.to_json(F.struct("_sets"))))
    return pairs.select(F.col("name").alias("src"), F.explode(F.from_json("paper_id", "_sets array<string>")["_sets"]).alias("dst")).distinct()


def quarantine(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers that can be built, papers without an abstract or an id)."""
    bad = F.col("abstract").isNull() | F.coalesce(F.col("arxiv_id"), F.lit("")).eqNullSafe("")
    return papers.where(~bad), papers.where(bad)


def build_graph(spark: SparkSession, topic: str, papers: DataFrame, texts: DataFrame, tables: DataFrame, equations: DataFrame, figures: DataFrame) -> Graph:
    """The graph of one topic's papers and their elements. Elements of other papers are left out."""
    good, _ = quarantine(papers)
    name = F.lower(py_strip(F.lit(topic)))
    ids = good.select(F.col("arxiv_id").alias("paper_id")).distinct()
    mine = lambda df: df.join(ids, "paper_id", "left_semi")
    texts, tables, equations, figures = mine(texts), mine(tables), mine(equations), mine(figures)
    g = Graph(spark)
    g.nodes["Topic"] = spark.range(1).select(name.alias("name"), F.lit(topic).alias("display_name"))
    g.nodes["Paper"] = merge_nodes(good.select("arxiv_id", "title", F.substring("abstract", 1, 2000).alias("abstract"), "published", "pdf_url", "primary_category", F.array_join("authors", ", ").alias("authors_str")), "Paper")
    wrote = good.select("arxiv_id", F.explode("authors").alias("a")).select(py_strip(F.col("a")).alias("name"), "arxiv_id").where("name <> ''")
    g.nodes["Author"] = merge_nodes(wrote.select("name"), "Author")
    said = lambda k: texts.select("paper_id", F.explode(F.coalesce(F.try_element_at("entities", F.lit(k)), F.array().cast("array<string>"))).alias("name"))
    ranked = benchmark_methods(tables)
    methods = said("methods").withColumn("from_table", F.lit(None).cast("boolean")).unionByName(ranked.withColumn("from_table", F.lit(True)))
    g.nodes["Method"] = merge_nodes(methods.select("name", "from_table"), "Method")
    g.nodes["Dataset"] = merge_nodes(said("datasets").select("name"), "Dataset")
    concepts = said("concepts").select("paper_id", F.lower("name").alias("name"), F.col("name").alias("display_name")).where(F.length("name") >= 3)
    g.nodes["Concept"] = merge_nodes(concepts.select("name", "display_name"), "Concept")
    g.nodes["Table"] = merge_nodes(tables.select("element_id", "paper_id", "page_number", "table_index", F.substring("content", 1, 1000).alias("content"), "col_count", "row_count", "is_benchmark", F.to_json("headers").alias("headers")), "Table")
    latex = equations.where(F.length("latex") >= 3)
    g.nodes["Equation"] = merge_nodes(latex.select("element_id", "paper_id", F.substring("latex", 1, 500).alias("latex"), "page_number", "source"), "Equation")
    g.nodes["Figure"] = merge_nodes(figures.where("element_type = 'figure'").select("element_id", "paper_id", "fig_number", F.substring("content", 1, 500).alias("caption"), "image_path", "page_number"), "Figure")
    edge = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    writes = {
        "INCLUDES": good.select(name.alias("src"), F.col("arxiv_id").alias("dst")), "WROTE": edge(wrote, "name", "arxiv_id"), "PROPOSES": edge(methods, "paper_id", "name"), "USES_DATASET": edge(said("datasets"), "paper_id", "name"),
        "MENTIONS": edge(concepts, "paper_id", "name"), "HAS_TABLE": edge(tables, "paper_id", "element_id"), "HAS_EQUATION": edge(latex, "paper_id", "element_id"), "HAS_FIGURE": edge(figures.where("element_type = 'figure'"), "paper_id", "element_id"),
    }
    for kind, rows in writes.items():
        g.edges[kind] = merge_edges(rows, kind, g)
    return g
