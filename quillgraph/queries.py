"""The queries that the driver runs for the reference operators, and equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import testbed as B
from . import workflows as W
from .functions import naming as N
from .functions import text as T
from .operators import extract as X
from .operators import graph as G
from .operators import routing as R
from .plans.catalog import named
from .sources import sinks, table

TOPIC, AUTHOR, METHOD_BRAND, DATASET, PAPER = "nation_3", "Customer#000000001", "Brand#1", "Supplier#000000003", "1"


def _flat(df: DataFrame) -> DataFrame:
    """Lists of text joined, as comparing lists across engines is brittle."""
    return df.select(*[F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema])


def _graph_query(name: str, **params):
    return lambda spark, d: _flat(named(B.star_graph(spark, d), name, **params))


def _method(spark: SparkSession, d: str) -> str:
    return table(spark, d, "part").select(F.min(F.concat_ws("/", "p_brand", "p_type")).alias("m")).first()["m"]


def _figure_paper(spark: SparkSession, d: str) -> str:
    return str(table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.min("l_orderkey").alias("k")).first()["k"])


PICK_METHOD = "(SELECT min(p_brand || '/' || p_type) FROM part)"
P_COLS = "p.arxiv_id, p.title, p.published"
BRANCHES = {
    "authors": ("wrote", "dst", "src", "n_author", "name", "name", None), "methods": ("proposes", "src", "dst", "n_method", "name", "name", None), "datasets": ("uses_dataset", "src", "dst", "n_dataset", "name", "name", None),
    "equations": ("has_equation", "src", "dst", "n_equation", "element_id", "latex", 3), "tables": ("has_table", "src", "dst", "n_table", "element_id", "content", 2), "figure_captions": ("has_figure", "src", "dst", "n_figure", "element_id", "caption", 4),
    "concepts": ("mentions", "src", "dst", "n_concept", "name", "name", None),
}


def _context_sql(papers: str, columns: str, which: list[str], most: dict[str, int | None] | None = None) -> str:
    """Each branch collected by paper; the papers of a context query are chosen first."""
    parts, joins, out = [], [], []
    for c in which:
        edge, near, far, node, key, value, cap = BRANCHES[c]
        cap = (most or {}).get(c, cap)
        cut = f"[1:{cap}]" if cap else ""
        parts.append(f"b_{c} AS (SELECT e.{near} AS pid, array_to_string(list_sort(list_distinct(list(n.{value}))){cut}, '|') AS v FROM {edge} e JOIN {node} n ON e.{far} = n.{key} WHERE e.{near} IN (SELECT arxiv_id FROM chosen) GROUP BY 1)")
        joins.append(f"LEFT JOIN b_{c} ON b_{c}.pid = c.arxiv_id")
        out.append(f"coalesce(b_{c}.v, '') AS {c}")
    head = B.star_sql("").rstrip()
    return f"{head}, chosen AS ({papers}),\n" + ",\n".join(parts) + f"\nSELECT {columns}, {', '.join(out)} FROM chosen c {' '.join(joins)}"


TOPIC_JOIN = f"includes i JOIN n_paper p ON i.dst = p.arxiv_id WHERE i.src = '{TOPIC}'"
ALL = list(BRANCHES)


def _classified(spark, d):
    lines = B.generated_lines(spark, d).withColumn("text", T.py_strip(F.col("line")))
    return lines.where(F.length("text") >= 3).groupBy(T.line_type(F.col("text")).alias("raw_type"), "kind").agg(F.count("*").alias("n"))


def _sql_re(p: str) -> str:
    """A pattern as RE2 and SQL want it."""
    return "'" + p.replace("'", "''") + "'"


#: White space as str.split() knows it, for RE2, whose own class is ASCII.
SPACE_CLASS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A line whose letters and numerals beyond ASCII are q, which no metric holds, and whose other characters beyond ASCII are ~, as RE2's word boundary is ASCII.
ASCII_LINE = r"regexp_replace(regexp_replace(line, '[^\p{L}\p{N}\x00-\x7F]', '~', 'g'), '[^\x00-\x7F]', 'q', 'g')"
LINE_TYPE_SQL = f"""CASE WHEN regexp_matches(line, {_sql_re("(?i)" + T.LINE_CAPTION)}) THEN 'FigureCaption' WHEN regexp_matches(line, {_sql_re("(?i)" + T.LINE_TITLE)}) AND length(line) < 80 THEN 'Title'
 WHEN regexp_matches(line, {_sql_re(T.LINE_FORMULA)}) AND length(line) < 200 THEN 'Formula' ELSE 'NarrativeText' END"""
KEEPS_SQL = r"(length(line) >= 15 AND NOT regexp_matches(line, '^\[\d+\]') AND NOT regexp_matches(line, '^\d+\.\s+[A-Z]'))"
SECTION_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, {_sql_re('(?i)' + p)}) THEN '{s}'" for s, p in T.SECTIONS) + " ELSE 'body' END"


def _mention_list_sql(names: tuple[str, ...], longer: int) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(line, {_sql_re('(?i)' + T.mention_pattern(names))}), lambda x: trim(x, ' \t\n')), lambda x: length(x) > {longer})))"


def _mentions_sql(names: tuple[str, ...], longer: int) -> str:
    return f"array_to_string({_mention_list_sql(names, longer)}, '|')"


def _entities_sql() -> str:
    """The map of entities as JSON, without empty categories."""
    lists = {"datasets": _mention_list_sql(T.DATASETS, 2), "methods": _mention_list_sql(T.METHODS, 2), "metrics": _mention_list_sql(T.METRICS, 1)}
    parts = ", ".join(f"""CASE WHEN len({v}) > 0 THEN '"{k}":["' || array_to_string({v}, '","') || '"]' END""" for k, v in lists.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def _mention_query(names, longer):
    return lambda s, d: B.generated_lines(s, d).select("line", F.array_join(T.mentions(F.col("line"), names, longer), "|").alias("found")).groupBy("line", "found").agg(F.count("*").alias("n"))


def _mention_sql(names, longer):
    return f"WITH {B.LINES_SQL} SELECT line, {_mentions_sql(names, longer)} AS found, count(*) AS n FROM lines GROUP BY 1, 2"


def _document_mentions(s, d):
    lines = B.document_lines(s, d)
    return lines.select("paper_id", F.explode(T.mentions(F.col("line"), T.METRICS, 1)).alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


def _carry(s, d):
    raw = B.generated_lines(s, d).select("paper_id", "page_number", (F.col("ordinal") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("line").alias("text"), T.line_type(F.col("line")).alias("raw_type"))
    got = X.text_elements(raw, "document")
    return got.groupBy("element_type", "section").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))


CARRY_SQL = f"""WITH {B.LINES_SQL}, t AS (SELECT paper_id, page_number, ordinal * 10 + l_linenumber AS ordinal, line, {LINE_TYPE_SQL} AS raw_type FROM lines),
k AS (SELECT *, CASE WHEN raw_type = 'Title' THEN {SECTION_SQL} END AS own FROM t WHERE raw_type IN ('Title', 'NarrativeText')),
c AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page_number, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS section FROM k)
SELECT CASE WHEN raw_type = 'Title' THEN 'title' ELSE 'text' END AS element_type, section, count(*) AS n, CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS words
FROM c WHERE (raw_type = 'Title' OR section <> 'references') AND {KEEPS_SQL} GROUP BY 1, 2"""


def _elements_summary(s, d):
    raw = B.generated_lines(s, d).select("paper_id", "page_number", "ordinal", F.col("line").alias("text"), T.line_type(F.col("line")).alias("raw_type"))
    got = X.text_elements(raw)
    return got.groupBy("element_type", "section").agg(F.count("*").alias("n"), F.sum(F.size(F.coalesce(F.try_element_at("entities", F.lit("methods")), F.array()))).cast("long").alias("methods"))


def _captions(s, d):
    lines = B.generated_lines(s, d).select("line").distinct()
    return lines.where(T.is_caption(F.col("line"))).select("line", T.caption_number(F.col("line")).alias("number"))


def _images(s, d):
    lines = B.generated_lines(s, d).where("kind = 7")
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("page_number", "ordinal"))
    return lines.select("paper_id", "page_number", "ordinal", n.alias("fig_counter"))


def _caption_rows(s, d):
    lines = B.generated_lines(s, d).where("kind IN (0, 1)")
    return lines.select("paper_id", "page_number", (F.col("page_number") * 100_000_000_000 + F.col("ordinal")).alias("ordinal"), F.col("line").alias("text"))


CAPTION_SQL = f"""WITH {B.LINES_SQL}, img AS (SELECT paper_id, page_number, ordinal, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page_number, ordinal) AS INTEGER) AS fig_counter FROM lines WHERE kind = 7),
cap AS (SELECT paper_id, page_number, CAST(page_number AS BIGINT) * 100000000000 + ordinal AS ord, line AS text, regexp_extract(line, '^(Figure|Table) (\\d+)', 0) AS num FROM lines WHERE kind IN (0, 1)),
pr AS (SELECT i.paper_id, i.page_number, i.fig_counter, c.ord, c.text, c.num, min(c.ord) OVER (PARTITION BY i.paper_id, i.fig_counter) AS first FROM img i LEFT JOIN cap c ON i.paper_id = c.paper_id AND abs(i.page_number - c.page_number) <= 1),
m AS (SELECT paper_id, page_number, fig_counter, coalesce(arg_max(text, ord) FILTER (WHERE ord > first AND contains(num, CAST(fig_counter AS VARCHAR))), arg_min(text, ord)) AS caption FROM pr GROUP BY 1, 2, 3)"""


def _figures(s, d):
    got = X.figure_elements(_images(s, d), _caption_rows(s, d))
    return got.groupBy("element_type", "unmatched").agg(F.count("*").alias("n"), F.count_distinct("content").alias("contents"), F.count("fig_number").alias("numbered"))


FIGURES_SQL = CAPTION_SQL + """, f AS (SELECT 'figure' AS element_type, false AS unmatched, coalesce(caption, '[Figure ' || fig_counter || ' on page ' || page_number || ']') AS content FROM m
UNION ALL SELECT 'caption', true, c.text FROM cap c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.paper_id = c.paper_id AND m.caption = c.text))
SELECT element_type, unmatched, count(*) AS n, count(DISTINCT content) AS contents, count(*) AS numbered FROM f GROUP BY 1, 2"""


def _tables(s, d):
    t = B.generated_tables(s, d)
    return t.select(X.is_benchmark(F.col("headers"), F.col("rows")).alias("benchmark"), X.is_benchmark(F.col("headers"), F.col("rows"), "word").alias("by_word")).groupBy("benchmark", "by_word").agg(F.count("*").alias("n"))


def _table_source(s, d):
    rows = B.generated_tables(s, d).withColumn("rows", F.concat(F.array("headers"), "rows"))
    html, other = rows.where(F.col("ordinal") % 3 == 0), rows.where(F.col("ordinal") % 3 != 0)
    got = X.table_elements(html.select("paper_id", "page_number", "ordinal", "rows"), other.select("paper_id", "page_number", "ordinal", "rows"))
    return got.groupBy("source", "is_benchmark").agg(F.count("*").alias("n"), F.max("table_index").alias("last"), F.sum("row_count").alias("rows"), F.sum("col_count").alias("cols"))


TABLE_SOURCE_SQL = f"""WITH {B.TABLES_SQL}, h AS (SELECT * FROM tabs WHERE ordinal % 3 = 0), o AS (SELECT * FROM tabs WHERE ordinal % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.paper_id = tabs.paper_id AND h.page_number = tabs.page_number)),
b AS (SELECT 'html' AS source, * FROM h UNION ALL SELECT 'pdfplumber', * FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY source <> 'html', page_number, ordinal) AS table_index, contains(lower(headers[1] || ' ' || headers[2]), 'accuracy') OR contains(lower(headers[1] || ' ' || headers[2]), 'map') AS is_benchmark FROM b)
SELECT source, is_benchmark, count(*) AS n, CAST(max(table_index) AS INTEGER) AS last, count(*) AS rows, 2 * count(*) AS cols FROM n GROUP BY 1, 2"""


def _benchmark_rows(s, d):
    t = B.generated_tables(s, d).withColumn("is_benchmark", X.is_benchmark(F.col("headers"), F.col("rows")))
    return G.benchmark_methods(t).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


def _merge_nodes(s, d):
    e = table(s, d, "events")
    writes = e.select((F.col("user_id") % 50).cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 7 == 1, True).alias("from_table"), "event_id")
    return G.merge_nodes(writes, "Method", ["event_id"])


def _merge_edges(s, d):
    g = B.star_graph(s, d)
    writes = table(s, d, "events").select(F.col("event_id").cast("string").alias("src"), F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % 20).cast("string"), 9, "0")).alias("dst"))
    return G.merge_edges(writes, "USES_DATASET", g)


def _context(s, d):
    rows = named(B.star_graph(s, d), "context_all_papers", limit=5)
    return R.context_lines(rows, [F.desc_nulls_first("published"), F.asc("arxiv_id")]).select(F.col("rank").cast("long").alias("rank"), "context")


CONTEXT_SQL = _context_sql("SELECT * FROM n_paper ORDER BY published DESC, arxiv_id LIMIT 5", "c.arxiv_id, c.title, c.abstract, c.published", ALL).replace("array_to_string(", "(").replace(", '|') AS v", ") AS v").replace(", '') AS", ", []) AS")
_bar = "repeat('=', 50)"
CONTEXT_SQL = f"""WITH x AS ({CONTEXT_SQL}), y AS (SELECT *, row_number() OVER (ORDER BY published DESC, arxiv_id) AS rank FROM x)
SELECT rank, concat_ws(chr(10), chr(10) || {_bar}, 'PAPER ' || rank, {_bar}, 'Title: ' || title, 'ArXiv ID: ' || arxiv_id, 'Published: ' || published, CASE WHEN len(authors) > 0 THEN 'Authors: ' || array_to_string(authors, ', ') END,
 chr(10) || 'Abstract:' || chr(10) || abstract, CASE WHEN len(methods) > 0 THEN chr(10) || 'Proposed Methods/Models: ' || array_to_string(methods, ', ') END, CASE WHEN len(datasets) > 0 THEN 'Datasets Used: ' || array_to_string(datasets, ', ') END,
 CASE WHEN len(equations) > 0 THEN chr(10) || 'Key Equations:' || chr(10) || array_to_string(list_transform(equations, lambda e: '  - ' || e), chr(10)) END, CASE WHEN len(tables) > 0 THEN chr(10) || 'Tables/Results:' || chr(10) || array_to_string(tables, chr(10)) END,
 CASE WHEN len(figure_captions) > 0 THEN chr(10) || 'Figures: ' || array_to_string(figure_captions, ' | ') END, CASE WHEN len(concepts) > 0 THEN 'Key Concepts: ' || array_to_string(concepts, ', ') END) AS context FROM y"""


def _summary_papers(s, d):
    return table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "downloaded").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("download_status"))


def _labels(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.col("c_name"), (F.col("o_orderkey") % 5).cast("int")))
    return o.select("o_orderkey", N.author_label(a).alias("label"), N.author_list(a).alias("listed"), N.pdf_filename(F.concat(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"))).alias("file"), N.preview(F.concat_ws("\n", "c_name", "o_orderpriority"), 25).alias("preview"))


LABELS_SQL = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, c_name, o_orderkey % 5 AS k FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CASE k WHEN 0 THEN 'Unknown' WHEN 1 THEN c_name ELSE c_name || ' +' || (k - 1) END AS label, CASE k WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_name || ', ' || c_name WHEN 3 THEN c_name || ', ' || c_name || ', ' || c_name ELSE c_name || ', ' || c_name || ', ' || c_name || ' et al.' END AS listed,
 o_orderstatus || '_' || o_orderkey || '.pdf' AS file, replace(substr(c_name || chr(10) || o_orderpriority, 1, 25), chr(10), ' ') AS preview FROM a"""


def _reparse(s, d):
    t = B.generated_tables(s, d).withColumn("content", X.table_text(F.col("headers"), F.col("rows")))
    cells = R.reparse_table(F.col("content"), F.col("headers"))
    return t.select(F.array_join(F.transform(cells, lambda r: F.array_join(r, ";")), "/").alias("cells")).groupBy("cells").agg(F.count("*").alias("n"))


def _html_pages(s, d):
    """A table for each page, of three shapes: with a header, with numbers first, and with tags, references and an empty row in between."""
    key, size = F.col("page_id").cast("string"), F.length("html").cast("string")
    made = [
        F.concat(F.lit("<table><tr><th>Page</th><th>Size</th></tr><tr><td>"), key, F.lit("</td><td> "), size, F.lit(" </td></tr></table>")),
        F.concat(F.lit("<table><tr><td>7.5</td><td>"), key, F.lit("</td></tr><tr><td>x</td><td>"), size, F.lit("</td></tr></table>")),
        F.concat(F.lit("<TABLE class='a>b'><!-- <tr><td>no</td></tr> --><TR><TH>Page <b>and</b> url</TH></TR><tr></tr><tr><td>"), key, F.lit("&amp;<i>"), size, F.lit("</i></td><td></td></tr><tr><td>lost")),
    ]
    pages = table(s, d, "pages").select(F.element_at(F.array(*made), (F.col("page_id") % 3 + 1).cast("int")).alias("html"))
    rows = pages.select(X.split_header(X.html_rows(F.col("html"))).alias("t"))
    return rows.select(F.array_join("t.headers", "|").alias("headers"), F.array_join(F.flatten("t.rows"), "|").alias("cells"))


def _page_tables(s, d):
    """The tables of the pages themselves; pages without rows of a table are left out."""
    rows = table(s, d, "pages").select("page_id", X.html_rows(F.col("html")).alias("rows")).where(F.size("rows") > 0)
    t = rows.select("page_id", X.split_header(F.col("rows")).alias("t"))
    return t.select("page_id", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


def _equations(s, d):
    e = T.equation_text(F.concat(F.col("line"), F.lit("   end")))
    return B.generated_lines(s, d).where("kind IN (4, 7)").select(e.alias("e")).groupBy("e.latex", "e.source").agg(F.count("*").alias("n"))


def _headers(s, d):
    """Tables of three shapes: with a header, with a number in the first row, and with the header alone."""
    k = F.col("ordinal") % 3
    t = B.generated_tables(s, d).select(F.when(k == 0, F.concat(F.array("headers"), "rows")).when(k == 1, F.concat("rows", F.array("headers"))).otherwise(F.array("headers")).alias("all"))
    said = lambda c: F.array_join(F.transform(c, lambda r: F.array_join(r, "|")), "/")
    both = t.select(X.split_header(F.col("all")).alias("a"), X.split_header(F.col("all"), 50, more_rows=False).alias("b"))
    return both.select(F.array_join("a.headers", "|").alias("headers"), said(F.col("a.rows")).alias("rest"), F.array_join("b.headers", "|").alias("headers_of_text"), said(F.col("b.rows")).alias("rest_of_text")).groupBy("headers", "rest", "headers_of_text", "rest_of_text").agg(F.count("*").alias("n"))


def _graph_totals(s, d):
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias(c)
    return R.graph_stats(B.star_graph(s, d)).select("all_label", "all_type", listed("by_label"), listed("by_type"))


QUERIES = {
    "papers_by_topic": _graph_query("papers_by_topic", topic=TOPIC),
    "all_topics": _graph_query("all_topics"),
    "paper_by_id": lambda s, d: named(B.star_graph(s, d), "paper_by_id", arxiv_id=PAPER).select("paper.*"),
    "papers_by_dataset": _graph_query("papers_by_dataset", dataset=DATASET),
    "papers_by_method": lambda s, d: named(B.star_graph(s, d), "papers_by_method", method=_method(s, d)),
    "papers_by_author": _graph_query("papers_by_author", author=AUTHOR),
    "methods_by_topic": _graph_query("methods_by_topic", topic=TOPIC),
    "datasets_for_method": lambda s, d: named(B.star_graph(s, d), "datasets_for_method", method=_method(s, d)),
    "tables_by_paper": _graph_query("tables_by_paper", arxiv_id=PAPER),
    "benchmark_tables_by_topic": _graph_query("benchmark_tables_by_topic", topic=TOPIC),
    "equations_by_paper": _graph_query("equations_by_paper", arxiv_id=PAPER),
    "figures_by_paper": lambda s, d: named(B.star_graph(s, d), "figures_by_paper", arxiv_id=_figure_paper(s, d)),
    "graph_stats": _graph_query("graph_stats"),
    "relationship_stats": _graph_query("relationship_stats"),
    "context_for_paper": _graph_query("context_for_paper", arxiv_id=PAPER),
    "context_for_topic": _graph_query("context_for_topic", topic=TOPIC, limit=10),
    "context_all_papers": _graph_query("context_all_papers", limit=10),
    "benchmark_tables": _graph_query("benchmark_tables"),
    "topic_papers": _graph_query("topic_papers", topic=TOPIC),
    "fallback_papers": _graph_query("fallback_papers"),
    "rich_figures": _graph_query("rich_figures"),
    "rich_tables": _graph_query("rich_tables"),
    "rich_equations": _graph_query("rich_equations"),
    "graph_totals": _graph_totals,
    "connectivity": lambda s, d: s.range(1).select(F.lit(1).alias("ok")),
    "classify_lines": _classified,
    "filter_text_lines": lambda s, d: B.generated_lines(s, d).where(T.keeps_text(F.col("line"))).groupBy("kind").agg(F.count("*").alias("n")),
    "classify_section": lambda s, d: B.generated_lines(s, d).groupBy(T.section_of(F.col("line")).alias("section"), "kind").agg(F.count("*").alias("n")),
    "section_carry_forward": _carry,
    "text_elements": _elements_summary,
    "word_counts": lambda s, d: B.document_lines(s, d).select("paper_id", "ordinal", T.word_count(F.col("line")).cast("long").alias("words")),
    "dataset_mentions": _mention_query(T.DATASETS, 2),
    "metric_mentions": _mention_query(T.METRICS, 1),
    "method_mentions": _mention_query(T.METHODS, 2),
    "document_metric_mentions": _document_mentions,
    "entity_map": lambda s, d: B.generated_lines(s, d).select("line", F.to_json(T.entity_map(F.col("line"))).alias("entities")).groupBy("line", "entities").agg(F.count("*").alias("n")),
    "normalise_types": lambda s, d: table(s, d, "events").select(T.raw_type_kind(F.element_at(F.array(*map(F.lit, [*T.RAW_TYPES, "Other"])), (F.col("event_id") % 14 + 1).cast("int"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")),
    "type_breakdown": lambda s, d: B.generated_lines(s, d).groupBy(T.raw_type_kind(T.line_type(F.col("line"))).alias("kind")).agg(F.count("*").alias("n")),
    "benchmark_table_test": _tables,
    "table_to_text": lambda s, d: B.generated_tables(s, d).select(X.table_text(F.col("headers"), F.col("rows")).alias("content")).groupBy("content").agg(F.count("*").alias("n")),
    "header_split": _headers,
    "table_source_precedence": _table_source,
    "html_table_parse": _html_pages,
    "page_tables": _page_tables,
    "equation_fallback": _equations,
    "caption_parse": _captions,
    "caption_match": lambda s, d: X.match_captions(_images(s, d), _caption_rows(s, d)).select("paper_id", "page_number", "fig_counter", "caption"),
    "unmatched_captions": _figures,
    "merge_nodes_last_write": _merge_nodes,
    "merge_edges_semi": _merge_edges,
    "benchmark_row_methods": _benchmark_rows,
    "element_stats": lambda s, d: X.element_stats(B.generated_lines(s, d).select("paper_id", T.raw_type_kind(T.line_type(F.col("line"))).alias("element_type"), F.col("line").alias("content"))),
    "query_type": lambda s, d: B.questions(s, d).groupBy("question", R.query_type(F.col("question")).alias("type")).agg(F.count("*").alias("n")),
    "rich_query_type": lambda s, d: B.questions(s, d).groupBy("question", R.rich_type(F.col("question")).alias("type")).agg(F.count("*").alias("n")),
    "context_string": _context,
    "table_reparse": _reparse,
    "cache_key": lambda s, d: table(s, d, "part").select("p_partkey", N.cache_key(F.col("p_name"), F.col("p_size")).alias("file")),
    "author_label": _labels,
    "download_summary": lambda s, d: sinks.download_summary(_summary_papers(s, d)),
    "element_ids": lambda s, d: table(s, d, "orders").select("o_orderkey", N.element_id(F.col("o_orderkey"), F.lit("table"), F.lit(1)).alias("element_id"), N.sidecar("table", F.col("o_orderkey") % 1000, F.col("o_custkey") % 10).alias("file")),
}

_tables_cols = "t.headers, t.content, t.page_number AS page"
ORACLE_SQL = {
    "papers_by_topic": B.star_sql(f"SELECT {P_COLS}, p.abstract, p.authors_str AS authors FROM {TOPIC_JOIN}"),
    "all_topics": B.star_sql("SELECT n.name AS topic, count(p.arxiv_id) AS paper_count FROM n_topic n LEFT JOIN includes i ON n.name = i.src LEFT JOIN n_paper p ON i.dst = p.arxiv_id GROUP BY 1"),
    "paper_by_id": B.star_sql(f"SELECT arxiv_id, title, abstract, published, primary_category, authors_str FROM n_paper WHERE arxiv_id = '{PAPER}'"),
    "papers_by_dataset": B.star_sql(f"SELECT {P_COLS} FROM uses_dataset u JOIN n_paper p ON u.src = p.arxiv_id WHERE u.dst = '{DATASET}'"),
    "papers_by_method": B.star_sql(f"SELECT {P_COLS} FROM proposes u JOIN n_paper p ON u.src = p.arxiv_id WHERE u.dst = {PICK_METHOD}"),
    "papers_by_author": B.star_sql(f"SELECT {P_COLS} FROM wrote u JOIN n_paper p ON u.dst = p.arxiv_id WHERE u.src = '{AUTHOR}'"),
    "methods_by_topic": B.star_sql(f"SELECT m.name AS method, array_to_string(list_sort(list_distinct(list(p.arxiv_id))), '|') AS papers, count(DISTINCT p.arxiv_id) AS paper_count FROM includes i JOIN n_paper p ON i.dst = p.arxiv_id JOIN proposes r ON r.src = p.arxiv_id JOIN n_method m ON r.dst = m.name WHERE i.src = '{TOPIC}' GROUP BY 1"),
    "datasets_for_method": B.star_sql(f"SELECT dst AS dataset FROM evaluated_on WHERE src = {PICK_METHOD}"),
    "tables_by_paper": B.star_sql(f"SELECT t.element_id, {_tables_cols}, t.col_count AS cols, t.row_count AS rows, t.is_benchmark FROM has_table h JOIN n_table t ON h.dst = t.element_id WHERE h.src = '{PAPER}'"),
    "benchmark_tables_by_topic": B.star_sql(f"SELECT p.title AS paper_title, p.arxiv_id, t.element_id, {_tables_cols} FROM includes i JOIN n_paper p ON i.dst = p.arxiv_id JOIN has_table h ON h.src = p.arxiv_id JOIN n_table t ON h.dst = t.element_id WHERE t.is_benchmark AND i.src = '{TOPIC}'"),
    "equations_by_paper": B.star_sql(f"SELECT t.element_id, t.latex, t.page_number AS page, t.source FROM has_equation h JOIN n_equation t ON h.dst = t.element_id WHERE h.src = '{PAPER}'"),
    "figures_by_paper": B.star_sql(f"SELECT t.element_id, t.fig_number, t.caption, t.image_path, t.page_number AS page FROM has_figure h JOIN n_figure t ON h.dst = t.element_id WHERE h.src = (SELECT CAST(min(l_orderkey) AS VARCHAR) FROM lineitem WHERE l_linestatus = 'O')"),
    "graph_stats": B.star_sql(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS count FROM n_{n.lower()}" for n in ("Topic", "Paper", "Author", "Method", "Dataset", "Concept", "Table", "Figure", "Equation"))),
    "relationship_stats": B.star_sql(" UNION ALL ".join(f"SELECT '{n}' AS relationship, count(*) AS count FROM {n.lower()}" for n in ("INCLUDES", "WROTE", "PROPOSES", "USES_DATASET", "MENTIONS", "EVALUATED_ON", "HAS_TABLE", "HAS_FIGURE", "HAS_EQUATION"))),
    "graph_totals": B.star_sql("SELECT sum(n) FILTER (WHERE node) AS all_label, sum(n) FILTER (WHERE NOT node) AS all_type, string_agg(name || '=' || n, '|' ORDER BY name) FILTER (WHERE node) AS by_label, string_agg(name || '=' || n, '|' ORDER BY name) FILTER (WHERE NOT node) AS by_type FROM (" + " UNION ALL ".join(f"SELECT {node} AS node, '{name}' AS name, count(*) AS n FROM {from_}" for node, name, from_ in [*(("true", k, f"n_{k.lower()}") for k in G.KEYS), *(("false", k, k.lower()) for k in G.EDGES if k.lower() in B.STAR_SQL)]) + ")").replace("sum(n) FILTER (WHERE node)", "CAST(sum(n) FILTER (WHERE node) AS BIGINT)").replace("sum(n) FILTER (WHERE NOT node)", "CAST(sum(n) FILTER (WHERE NOT node) AS BIGINT)"),
    "context_for_paper": _context_sql(f"SELECT * FROM n_paper WHERE arxiv_id = '{PAPER}'", "c.title, c.abstract, c.published", ALL, {"equations": None, "tables": 3, "figure_captions": 5}),
    "context_for_topic": _context_sql(f"SELECT p.* FROM {TOPIC_JOIN} ORDER BY published DESC, arxiv_id LIMIT 10", "c.arxiv_id, c.title, c.abstract", ["methods", "datasets", "authors"]),
    "context_all_papers": _context_sql("SELECT * FROM n_paper ORDER BY published DESC, arxiv_id LIMIT 10", "c.arxiv_id, c.title, c.abstract, c.published", ALL),
    "benchmark_tables": B.star_sql(f"SELECT p.title, p.arxiv_id, {_tables_cols} FROM n_paper p JOIN has_table h ON h.src = p.arxiv_id JOIN n_table t ON h.dst = t.element_id WHERE t.is_benchmark"),
    "topic_papers": B.star_sql(f"SELECT {P_COLS}, p.abstract FROM {TOPIC_JOIN}"),
    "fallback_papers": B.star_sql("SELECT arxiv_id, title, published FROM n_paper ORDER BY arxiv_id LIMIT 20"),
    "rich_figures": B.star_sql("SELECT p.title AS paper, p.arxiv_id, f.fig_number, f.caption, f.image_path, f.page_number AS page FROM n_paper p JOIN has_figure h ON h.src = p.arxiv_id JOIN n_figure f ON h.dst = f.element_id WHERE f.image_path IS NOT NULL AND f.image_path <> '' ORDER BY p.published DESC, f.page_number, p.arxiv_id, f.element_id LIMIT 12"),
    "rich_tables": B.star_sql(f"SELECT p.title AS paper, p.arxiv_id, {_tables_cols}, t.is_benchmark, t.row_count AS rows, t.col_count AS cols FROM n_paper p JOIN has_table h ON h.src = p.arxiv_id JOIN n_table t ON h.dst = t.element_id ORDER BY t.is_benchmark DESC, p.published DESC, p.arxiv_id, t.element_id LIMIT 10"),
    "rich_equations": B.star_sql("SELECT p.title AS paper, p.arxiv_id, e.latex, e.page_number AS page, e.source FROM n_paper p JOIN has_equation h ON h.src = p.arxiv_id JOIN n_equation e ON h.dst = e.element_id ORDER BY p.published DESC, e.page_number, p.arxiv_id, e.element_id LIMIT 15"),
    "connectivity": "SELECT CAST(1 AS INTEGER) AS ok",
    "classify_lines": f"WITH {B.LINES_SQL} SELECT {LINE_TYPE_SQL} AS raw_type, kind, count(*) AS n FROM lines GROUP BY 1, 2",
    "filter_text_lines": f"WITH {B.LINES_SQL} SELECT kind, count(*) AS n FROM lines WHERE {KEEPS_SQL} GROUP BY 1",
    "classify_section": f"WITH {B.LINES_SQL} SELECT {SECTION_SQL} AS section, kind, count(*) AS n FROM lines GROUP BY 1, 2",
    "section_carry_forward": CARRY_SQL,
    "text_elements": f"WITH {B.LINES_SQL}, t AS (SELECT line, {LINE_TYPE_SQL} AS raw_type FROM lines) SELECT CASE WHEN raw_type = 'Title' THEN 'title' ELSE 'text' END AS element_type, CASE WHEN raw_type = 'Title' THEN {SECTION_SQL} ELSE 'body' END AS section, count(*) AS n, CAST(sum(len({_mention_list_sql(T.METHODS, 2)})) AS BIGINT) AS methods FROM t WHERE raw_type IN ('Title', 'NarrativeText') AND {KEEPS_SQL} GROUP BY 1, 2",
    "word_counts": f"WITH {B.DOCUMENT_LINES_SQL} SELECT paper_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(len(regexp_extract_all(line, '[^{SPACE_CLASS}]+')) AS BIGINT) AS words FROM dl",
    "dataset_mentions": _mention_sql(T.DATASETS, 2),
    "metric_mentions": _mention_sql(T.METRICS, 1),
    "method_mentions": _mention_sql(T.METHODS, 2),
    "entity_map": f"WITH {B.LINES_SQL}, one AS (SELECT line, count(*) AS n FROM lines GROUP BY 1) SELECT line, {_entities_sql()} AS entities, n FROM one",
    "document_metric_mentions": f"WITH {B.DOCUMENT_LINES_SQL}, e AS (SELECT paper_id, unnest(list_distinct(list_filter(regexp_extract_all({ASCII_LINE}, {_sql_re('(?i)' + T.mention_pattern(T.METRICS))}), lambda x: length(x) > 1))) AS name FROM dl) SELECT name, count(*) AS n, count(DISTINCT paper_id) AS papers FROM e GROUP BY 1",
    "normalise_types": "WITH k AS (SELECT [" + ", ".join(f"'{v}'" for v in [*T.RAW_TYPES.values(), "text"]) + "][event_id % 14 + 1] AS kind FROM events) SELECT kind, count(*) AS n FROM k GROUP BY 1",
    "type_breakdown": f"WITH {B.LINES_SQL}, t AS (SELECT {LINE_TYPE_SQL} AS r FROM lines) SELECT CASE r WHEN 'FigureCaption' THEN 'caption' WHEN 'Title' THEN 'title' WHEN 'Formula' THEN 'equation' ELSE 'text' END AS kind, count(*) AS n FROM t GROUP BY 1",
    "benchmark_table_test": f"WITH {B.TABLES_SQL} SELECT contains(headers[2], 'accuracy') OR contains(headers[2], 'map') AS benchmark, contains(headers[2], 'accuracy') AS by_word, count(*) AS n FROM tabs GROUP BY 1, 2",
    "table_to_text": f"WITH {B.TABLES_SQL} SELECT headers[1] || ' | ' || headers[2] || chr(10) || repeat('-', length(headers[1]) + length(headers[2]) + 6) || chr(10) || p_name || ' | ' || qty AS content, count(*) AS n FROM tabs GROUP BY 1",
    "header_split": f"""WITH {B.TABLES_SQL}, r AS (SELECT ordinal % 3 AS k, headers[1] || '|' || headers[2] AS h, p_name || '|' || qty AS c FROM tabs)
SELECT CASE k WHEN 0 THEN h ELSE '' END AS headers, CASE k WHEN 0 THEN c WHEN 1 THEN c || '/' || h ELSE h END AS rest, CASE k WHEN 1 THEN '' ELSE h END AS headers_of_text, CASE k WHEN 0 THEN c WHEN 1 THEN c || '/' || h ELSE '' END AS rest_of_text, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""",
    "table_source_precedence": TABLE_SOURCE_SQL,
    "html_table_parse": "SELECT CASE page_id % 3 WHEN 0 THEN 'Page|Size' WHEN 1 THEN '' ELSE 'Page and url' END AS headers, CASE page_id % 3 WHEN 0 THEN page_id || '|' || length(html) WHEN 1 THEN '7.5|' || page_id || '|x|' || length(html) ELSE page_id || '&' || length(html) || '|' END AS cells FROM pages",
    "equation_fallback": f"WITH {B.LINES_SQL} SELECT CASE kind WHEN 4 THEN line || '   end' ELSE line || ' end' END AS latex, CASE kind WHEN 4 THEN 'latex_hint' ELSE 'raw_text' END AS source, count(*) AS n FROM lines WHERE kind IN (4, 7) GROUP BY 1, 2",
    "caption_parse": f"WITH {B.LINES_SQL} SELECT DISTINCT line, regexp_extract(line, '^(Figure|Table) [0-9]+') AS number FROM lines WHERE kind IN (0, 1)",
    "caption_match": CAPTION_SQL + " SELECT paper_id, page_number, fig_counter, caption FROM m",
    "unmatched_captions": FIGURES_SQL,
    "merge_nodes_last_write": "SELECT CAST(user_id % 50 AS VARCHAR) AS name, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 = 0) AS kind, bool_or(CASE WHEN event_id % 7 = 1 THEN true END) AS from_table FROM events GROUP BY 1",
    "merge_edges_semi": B.star_sql("SELECT DISTINCT CAST(event_id AS VARCHAR) AS src, 'Supplier#' || lpad(CAST(user_id % 20 AS VARCHAR), 9, '0') AS dst FROM events WHERE CAST(event_id AS VARCHAR) IN (SELECT arxiv_id FROM n_paper) AND 'Supplier#' || lpad(CAST(user_id % 20 AS VARCHAR), 9, '0') IN (SELECT name FROM n_dataset)"),
    "benchmark_row_methods": f"WITH {B.TABLES_SQL} SELECT p_name AS name, count(*) AS n, count(DISTINCT paper_id) AS papers FROM tabs WHERE contains(headers[2], 'accuracy') OR contains(headers[2], 'map') GROUP BY 1",
    "element_stats": f"WITH {B.LINES_SQL}, t AS (SELECT paper_id, {LINE_TYPE_SQL} AS r FROM lines) SELECT paper_id, CASE r WHEN 'FigureCaption' THEN 'caption' WHEN 'Title' THEN 'title' WHEN 'Formula' THEN 'equation' ELSE 'text' END AS element_type, count(*) AS n FROM t GROUP BY 1, 2",
    "context_string": CONTEXT_SQL,
    "table_reparse": f"WITH {B.TABLES_SQL} SELECT headers[1] || ';' || headers[2] || '/' || p_name || ';' || qty AS cells, count(*) AS n FROM tabs GROUP BY 1",
    "cache_key": "SELECT p_partkey, lower(replace(substr(p_name, 1, 40), ' ', '_')) || '_' || substr(md5(p_name || '|' || p_size), 1, 10) || '.json' AS file FROM part",
    "author_label": LABELS_SQL,
    "download_summary": "SELECT count(*) AS count, count(*) FILTER (WHERE o_orderstatus = 'F') AS downloaded, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders",
    "element_ids": "SELECT o_orderkey, substr(sha256(o_orderkey || '|table|1'), 1, 12) AS element_id, 'table_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '_p' || (o_custkey % 10) || '.json' AS file FROM orders",
}


def _route_sql(words, other: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower(question), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in words)
    return f"WITH {B.QUESTIONS_SQL} SELECT question, CASE {cases} ELSE '{other}' END AS type, count(*) AS n FROM q GROUP BY 1, 2"


ORACLE_SQL |= {"query_type": _route_sql(R.QUESTION_WORDS, "general"), "rich_query_type": _route_sql(R.RICH_WORDS, "text")}

QUERIES |= W.QUERIES
ORACLE_SQL |= {
    "build_graph": W.BUILD_SQL,
    "stored_graph": W.STORED_SQL,
    "route_elements": f"""WITH {B.LINES_SQL}, t AS (SELECT line, {LINE_TYPE_SQL} AS r FROM lines) SELECT CASE r WHEN 'Title' THEN 'title' ELSE 'text' END AS what, count(*) AS n FROM t WHERE r IN ('Title', 'NarrativeText') AND {KEEPS_SQL} GROUP BY 1
 UNION ALL SELECT 'caption: RuntimeError: no captions today', 1 UNION ALL SELECT 'left: equation', count(*) FROM t WHERE r = 'Formula'""",
    "route_pages": f"WITH {B.LINES_SQL}, t AS (SELECT line, {LINE_TYPE_SQL} AS r FROM lines) SELECT CASE r WHEN 'Title' THEN 'title' WHEN 'Formula' THEN 'equation' WHEN 'FigureCaption' THEN 'caption' ELSE 'text' END AS element_type, count(*) AS n FROM t WHERE r IN ('Formula', 'FigureCaption') OR {KEEPS_SQL} GROUP BY 1",
    "route_report": W.REPORT_SQL,
    "search_cache_round_trip": W.CACHE_SQL,
    "batch_round_trip": W.BATCH_SQL,
    "extraction_round_trip": "SELECT CAST(n_regionkey AS VARCHAR) AS paper_id, count(*) AS elements, CAST(sum(n_nationkey) AS BIGINT) AS pages, min(n_name) AS first, CAST(1 AS INTEGER) AS errors FROM nation GROUP BY 1",
    "pdf_report": "WITH v AS (SELECT o_orderkey || '.pdf' AS name, o_orderkey * 1024 AS length FROM orders WHERE o_orderkey % 3 <> 0) SELECT count(*) AS files, CAST(sum(length) AS BIGINT) / 1048576.0::DOUBLE AS mb, (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT name FROM v ORDER BY name LIMIT 10)) AS names FROM v",
    "answer_parts": W.PARTS_SQL,
    "first_seen_groups": W.GROUPS_SQL,
    "element_summary": f"""WITH {B.LINES_SQL}, t AS (SELECT paper_id, {LINE_TYPE_SQL} AS r FROM lines), k AS (SELECT paper_id, CASE r WHEN 'FigureCaption' THEN 'caption' WHEN 'Title' THEN 'title' WHEN 'Formula' THEN 'equation' ELSE 'text' END AS kind, count(*) AS n FROM t GROUP BY 1, 2)
SELECT paper_id, string_agg(kind || ': ' || n, ', ' ORDER BY kind || ': ' || n) AS summary FROM k GROUP BY 1""",
    "raw_type_counts": f"WITH {B.LINES_SQL} SELECT {LINE_TYPE_SQL} AS raw_type, count(*) AS n FROM lines GROUP BY 1",
    "ask_sources": B.star_sql(W.ASKED_SQL),
    "rich_content": ORACLE_SQL["rich_tables"],
    "retrieve_papers": B.star_sql("SELECT p.arxiv_id, p.title, p.published, (SELECT count(DISTINCT dst) FROM proposes WHERE src = p.arxiv_id) AS methods FROM n_paper p ORDER BY p.published DESC, p.arxiv_id LIMIT 7"),
}
