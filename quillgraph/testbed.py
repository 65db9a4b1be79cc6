"""Driver tables seen as papers, graphs and pages, so that every operator has rows to work on.

B: the star schema as a property graph (orders are papers, customers authors, parts methods, ...).
C: one generated line of text for each line item, of eight kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph, merge_nodes
from .sources import table

S = lambda c: F.col(c).cast("string")


def item_id() -> Column:
    """Line items have no key of their own; these columns together are unique up to rare repeats, which merge."""
    return F.concat_ws("-", S("l_orderkey"), S("l_linenumber"), S("l_partkey"), S("l_suppkey"), F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("int").cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Testbed B. Tables that a query doesn't touch are never read."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").withColumn("element_id", item_id()).withColumn("paper_id", S("l_orderkey"))
    parts = t("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("name"))
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey")
    topics = t("nation").select("n_nationkey", F.lower("n_name").alias("name"), F.col("n_name").alias("display_name"))
    orders = t("orders")
    papers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    content = F.concat_ws(" | ", S("l_partkey"), S("l_suppkey"), F.col("l_quantity").cast("int").cast("string"))
    g = Graph(spark)
    g.nodes = {
        "Topic": topics.select("name", "display_name"),
        "Paper": papers.select(S("o_orderkey").alias("arxiv_id"), F.concat(F.lit("Order "), S("o_orderkey")).alias("title"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("abstract"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"), F.col("o_orderstatus").alias("primary_category"), F.col("c_name").alias("authors_str")),
        "Author": customers.select(F.col("c_name").alias("name")),
        "Method": merge_nodes(parts.select("name"), "Method"),
        "Dataset": t("supplier").select(F.col("s_name").alias("name")),
        "Concept": merge_nodes(orders.select(F.lower("o_orderpriority").alias("name"), F.col("o_orderpriority").alias("display_name")), "Concept"),
        "Table": merge_nodes(items.select("element_id", "paper_id", F.col("l_linenumber").alias("page_number"), content.alias("content"), F.lit(2).alias("col_count"), F.col("l_quantity").cast("int").alias("row_count"), (F.col("l_returnflag") == "R").alias("is_benchmark"), F.to_json(F.array("l_returnflag", "l_linestatus")).alias("headers")), "Table"),
        "Figure": merge_nodes(items.where("l_linestatus = 'O'").select("element_id", "paper_id", F.concat(F.lit("Figure "), S("l_linenumber")).alias("fig_number"), F.concat(F.lit("View of part "), S("l_partkey")).alias("caption"), F.when(F.col("l_partkey") % 5 == 0, None).when(F.col("l_partkey") % 5 == 1, "").otherwise(F.concat(F.lit("fig_"), S("l_suppkey"), F.lit(".png"))).alias("image_path"), F.col("l_linenumber").alias("page_number")), "Figure"),
        "Equation": merge_nodes(items.where("l_linestatus = 'F'").select("element_id", "paper_id", F.concat(F.lit("x = "), S("l_partkey"), F.lit(" + "), S("l_suppkey")).alias("latex"), F.col("l_linenumber").alias("page_number"), F.lit("raw_text").alias("source")), "Equation"),
    }
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst")).distinct()
    of = lambda cond: items.where(cond)
    g.edges = {
        "INCLUDES": papers.join(topics, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("name").alias("src"), S("o_orderkey").alias("dst")),
        "WROTE": papers.select(F.col("c_name").alias("src"), S("o_orderkey").alias("dst")),
        "PROPOSES": edge(items.join(parts, F.col("l_partkey") == F.col("p_partkey")), F.col("paper_id"), F.col("name")),
        "USES_DATASET": edge(items.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), F.col("paper_id"), F.col("s_name")),
        "MENTIONS": orders.select(S("o_orderkey").alias("src"), F.lower("o_orderpriority").alias("dst")),
        "EVALUATED_ON": edge(items.where("l_returnflag = 'R'").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), F.col("name"), F.col("s_name")),
        "HAS_TABLE": edge(items, F.col("paper_id"), F.col("element_id")),
        "HAS_FIGURE": edge(of("l_linestatus = 'O'"), F.col("paper_id"), F.col("element_id")),
        "HAS_EQUATION": edge(of("l_linestatus = 'F'"), F.col("paper_id"), F.col("element_id")),
    }
    return g


ITEM_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS INTEGER))"

#: The tables of star_graph in SQL, by name; each may use those before it.
STAR_SQL = {
    "items": f"SELECT *, {ITEM_SQL} AS element_id, CAST(l_orderkey AS VARCHAR) AS paper_id FROM lineitem",
    "papers_": "SELECT o.*, c_name, c_nationkey, CAST(o_orderkey AS VARCHAR) AS id FROM orders o JOIN customer ON o_custkey = c_custkey",
    "n_topic": "SELECT lower(n_name) AS name, n_name AS display_name, n_nationkey FROM nation",
    "n_paper": "SELECT id AS arxiv_id, 'Order ' || id AS title, concat_ws(' ', o_orderstatus, o_orderpriority) AS abstract, strftime(o_orderdate, '%Y-%m-%d') AS published, o_orderstatus AS primary_category, c_name AS authors_str FROM papers_",
    "n_author": "SELECT c_name AS name FROM customer",
    "n_method": "SELECT DISTINCT p_brand || '/' || p_type AS name FROM part",
    "n_dataset": "SELECT s_name AS name FROM supplier",
    "n_concept": "SELECT DISTINCT lower(o_orderpriority) AS name FROM orders",
    "n_table": "SELECT DISTINCT element_id, l_linenumber AS page_number, concat_ws(' | ', l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS content, 2 AS col_count, CAST(l_quantity AS INTEGER) AS row_count, l_returnflag = 'R' AS is_benchmark, '[\"' || l_returnflag || '\",\"' || l_linestatus || '\"]' AS headers FROM items",
    "n_figure": "SELECT DISTINCT element_id, 'Figure ' || l_linenumber AS fig_number, 'View of part ' || l_partkey AS caption, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN '' ELSE 'fig_' || l_suppkey || '.png' END AS image_path, l_linenumber AS page_number FROM items WHERE l_linestatus = 'O'",
    "n_equation": "SELECT DISTINCT element_id, 'x = ' || l_partkey || ' + ' || l_suppkey AS latex, l_linenumber AS page_number, 'raw_text' AS source FROM items WHERE l_linestatus = 'F'",
    "includes": "SELECT name AS src, id AS dst FROM papers_ JOIN n_topic ON c_nationkey = n_nationkey",
    "wrote": "SELECT c_name AS src, id AS dst FROM papers_",
    "proposes": "SELECT DISTINCT paper_id AS src, p_brand || '/' || p_type AS dst FROM items JOIN part ON l_partkey = p_partkey",
    "uses_dataset": "SELECT DISTINCT paper_id AS src, s_name AS dst FROM items JOIN supplier ON l_suppkey = s_suppkey",
    "mentions": "SELECT CAST(o_orderkey AS VARCHAR) AS src, lower(o_orderpriority) AS dst FROM orders",
    "evaluated_on": "SELECT DISTINCT p_brand || '/' || p_type AS src, s_name AS dst FROM items JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'",
    "has_table": "SELECT DISTINCT paper_id AS src, element_id AS dst FROM items",
    "has_figure": "SELECT DISTINCT paper_id AS src, element_id AS dst FROM items WHERE l_linestatus = 'O'",
    "has_equation": "SELECT DISTINCT paper_id AS src, element_id AS dst FROM items WHERE l_linestatus = 'F'",
}


def star_sql(select: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in STAR_SQL.items()) + "\n" + select


#: Lines with names from the lexicons; one of them for each part in turn.
MENTION_LINES = (
    "We train BERT and ResNet-50 on ImageNet and COCO with mAP",
    "GPT-4 reaches 71.2 BLEU-4 and ROUGE-L on WMT-14",
    "Swin Transformer and ViT on ADE20K, mIoU and FPS",
    "Nothing to see here, only words that mention none",
    "top-1 accuracy of EfficientNet-B7 on CIFAR-100 and MNIST",
    "StyleGAN2, DDPM and CLIP: FID and LPIPS on FFHQ",
    "Faster R-CNN, YOLOv5 and DETR compared on MS COCO by AP50",
    "RoBERTa and T5 on SQuAD 2.0 and GLUE, F1-score and perplexity",
    "precision, recall; recall, precision on KITTI",
)


def generated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testbed C: (paper_id, page_number, ordinal, line, l_*)."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind = (F.col("l_partkey") + F.col("l_linenumber")) % 8
    made = [
        F.concat(F.lit("Figure "), (F.col("l_partkey") % 12).cast("string"), F.lit(": view of "), F.col("p_name")),
        F.concat(F.lit("Table "), (F.col("l_suppkey") % 9).cast("string"), F.lit(". accuracy of "), F.col("p_brand")),
        F.concat(S("l_linenumber"), F.lit(" Introduction to "), F.col("p_name")),
        F.lit("References and appendix list"),
        F.concat(F.lit("loss = "), S("l_partkey"), F.lit(" + x_{i}")),
        F.concat(F.lit("["), S("l_linenumber"), F.lit("] Someone et al.")),
        F.element_at(F.array(*map(F.lit, MENTION_LINES)), (F.col("l_partkey") % len(MENTION_LINES) + 1).cast("int")),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" narrative sentence")),
    ]
    line = F.element_at(F.array(*made), (kind + 1).cast("int"))
    return joined.select(S("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ordinal"), line.alias("line"), kind.alias("kind"), "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("qty"), "p_type", "p_name", "p_brand")


_MENTIONS_SQL = "[" + ", ".join(f"'{x}'" for x in MENTION_LINES) + f"][l_partkey % {len(MENTION_LINES)} + 1]"
LINES_SQL = f"""lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, l_linenumber AS page_number, l_partkey * 100000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ordinal,
 (l_partkey + l_linenumber) % 8 AS kind, CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN 'Figure ' || (l_partkey % 12) || ': view of ' || p_name WHEN 1 THEN 'Table ' || (l_suppkey % 9) || '. accuracy of ' || p_brand
 WHEN 2 THEN l_linenumber || ' Introduction to ' || p_name WHEN 3 THEN 'References and appendix list' WHEN 4 THEN 'loss = ' || l_partkey || ' + x_{{i}}' WHEN 5 THEN '[' || l_linenumber || '] Someone et al.'
 WHEN 6 THEN {_MENTIONS_SQL} ELSE p_name || ' ' || p_type || ' narrative sentence' END AS line,
 l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS qty, p_type, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def generated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testbed C: a table (paper_id, page_number, ordinal, headers, rows) for each line."""
    word = F.element_at(F.array(F.lit("accuracy"), F.lit("price"), F.lit("mapping")), (F.col("l_partkey") % 3 + 1).cast("int"))
    lines = generated_lines(spark, sf_dir)
    return lines.select("paper_id", "page_number", "ordinal", F.array("p_type", word).alias("headers"), F.array(F.array("p_name", F.col("qty").cast("string"))).alias("rows"))


TABLES_SQL = LINES_SQL + ", tabs AS (SELECT paper_id, page_number, ordinal, [p_type, CASE l_partkey % 3 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'price' ELSE 'mapping' END] AS headers, p_name, qty FROM lines)"

#: Questions for routing, one or more for each branch.
QUESTIONS = (
    "Show me the benchmark results", "attention score?", "accuracy numbers", "show figures", "Which authors wrote these papers?", "What methods are proposed", "are they undefined", "Summarise the contributions",
    "LATEX please", "which TABLE compares them", "a picture of it", "trained on what", "hello",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("event_id") % len(QUESTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pick.alias("question"))


QUESTIONS_SQL = "q AS (SELECT event_id, [" + ", ".join(f"'{x}'" for x in QUESTIONS) + f"][event_id % {len(QUESTIONS)} + 1] AS question FROM events)"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Testbed A: the lines of all documents."""
    return table(spark, sf_dir, "documents").select(S("doc_id").alias("paper_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))


DOCUMENT_LINES_SQL = "dl AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, 1 AS page_number, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents)"
