"""Queries over whole workflows: routing, graph building, stored graphs, files written and read, answers; and equivalent SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from . import testbed as B
from .functions import naming as N
from .functions import text as T
from .operators import extract as X
from .operators import graph as G
from .operators import router
from .operators import routing as R
from .plans.catalog import named
from .sources import sinks, table
from .sources.shared import fresh_path


def _counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])


def built_graph(s: SparkSession, d: str) -> G.Graph:
    """build_graph over papers, texts, tables, equations and figures made from the star schema."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    papers = o.select(
        key.cast("string").alias("arxiv_id"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), F.when(key % 11 != 0, F.repeat(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"), (key % 400).cast("int"))).alias("abstract"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published"), F.lit(None).cast("string").alias("pdf_url"), F.col("o_orderstatus").alias("primary_category"), F.array("c_name", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), F.lit(" ")).alias("authors"),
    )
    items = table(s, d, "lineitem").withColumn("element_id", B.item_id()).withColumn("paper_id", F.col("l_orderkey").cast("string"))
    of_part = items.join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.create_map(F.lit("methods"), F.array("p_brand"), F.lit("datasets"), F.array(F.concat(F.lit("D"), (F.col("l_suppkey") % 50).cast("string"))), F.lit("concepts"), F.array("p_type", F.lit("ab")))
    tables = B.generated_tables(s, d).withColumn("is_benchmark", X.is_benchmark(F.col("headers"), F.col("rows"))).withColumn("content", X.table_text(F.col("headers"), F.col("rows")))
    tables = tables.withColumns({"table_index": F.col("ordinal"), "col_count": F.size("headers"), "row_count": F.size("rows")})
    equations = items.where("l_linestatus = 'F'").select("element_id", "paper_id", F.when(F.col("l_partkey") % 4 == 0, "x").otherwise(F.concat(F.lit("x = "), F.col("l_partkey").cast("string"))).alias("latex"), F.col("l_linenumber").alias("page_number"), F.lit("raw_text").alias("source"))
    figures = items.where("l_linestatus = 'O'").select("element_id", "paper_id", F.when(F.col("l_partkey") % 3 == 0, "caption").otherwise("figure").alias("element_type"), F.lit("Figure 1").alias("fig_number"), F.lit("view").alias("content"), F.lit(None).cast("string").alias("image_path"), F.col("l_linenumber").alias("page_number"))
    return G.build_graph(s, "Orders ", papers, of_part.select("paper_id", said.alias("entities")), X.with_element_ids(tables, "table", "ordinal"), equations, figures)


def _build_graph(s, d):
    g = built_graph(s, d)
    more = {"methods from tables": g.node("Method").where("from_table"), "abstracts of 2,000": g.node("Paper").where("length(abstract) = 2000"), "benchmark tables": g.node("Table").where("is_benchmark"), "topic orders": g.node("Topic").where("name = 'orders'")}
    return _counts({k.lower(): v for k, v in {**g.nodes, **g.edges}.items()} | more)


BUILD_SQL = f"""WITH {B.LINES_SQL}, it AS (SELECT *, {B.ITEM_SQL} AS element_id, CAST(l_orderkey AS VARCHAR) AS pid FROM lineitem),
gp AS (SELECT CAST(o_orderkey AS VARCHAR) AS pid, c_name, trim(o_orderpriority) AS pr, (length(o_orderstatus) + 1 + length(o_orderpriority)) * (o_orderkey % 400) AS l FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 0),
tx AS (SELECT pid, p_brand, 'D' || (l_suppkey % 50) AS ds, lower(p_type) AS c FROM it JOIN part ON l_partkey = p_partkey JOIN gp USING (pid)),
tb AS (SELECT DISTINCT paper_id AS pid, ordinal, trim(p_name) AS first, CASE l_partkey % 3 WHEN 1 THEN contains(lower(p_type), 'map') ELSE true END AS bench FROM lines JOIN gp ON paper_id = pid),
bm AS (SELECT pid, first FROM tb WHERE bench AND length(first) >= 2),
eq AS (SELECT pid, element_id FROM it JOIN gp USING (pid) WHERE l_linestatus = 'F' AND l_partkey % 4 <> 0),
fg AS (SELECT pid, element_id FROM it JOIN gp USING (pid) WHERE l_linestatus = 'O' AND l_partkey % 3 <> 0),
au AS (SELECT pid, c_name AS a FROM gp UNION SELECT pid, pr FROM gp),
me AS (SELECT pid, p_brand AS m FROM tx UNION SELECT pid, first FROM bm)
SELECT 'topic' AS name, 1 AS n UNION ALL SELECT 'topic orders', 1 UNION ALL SELECT 'paper', count(*) FROM gp UNION ALL SELECT 'author', count(DISTINCT a) FROM au UNION ALL SELECT 'method', count(DISTINCT m) FROM me
UNION ALL SELECT 'dataset', count(DISTINCT ds) FROM tx UNION ALL SELECT 'concept', count(DISTINCT c) FROM tx UNION ALL SELECT 'table', count(DISTINCT (pid, ordinal)) FROM tb UNION ALL SELECT 'equation', count(DISTINCT element_id) FROM eq UNION ALL SELECT 'figure', count(DISTINCT element_id) FROM fg
UNION ALL SELECT 'includes', count(*) FROM gp UNION ALL SELECT 'wrote', count(*) FROM au UNION ALL SELECT 'proposes', count(*) FROM me UNION ALL SELECT 'uses_dataset', count(DISTINCT (pid, ds)) FROM tx UNION ALL SELECT 'mentions', count(DISTINCT (pid, c)) FROM tx
UNION ALL SELECT 'has_table', count(DISTINCT (pid, ordinal)) FROM tb UNION ALL SELECT 'has_equation', count(DISTINCT (pid, element_id)) FROM eq UNION ALL SELECT 'has_figure', count(DISTINCT (pid, element_id)) FROM fg
UNION ALL SELECT 'methods from tables', count(DISTINCT first) FROM bm UNION ALL SELECT 'abstracts of 2,000', count(*) FROM gp WHERE l >= 2000 UNION ALL SELECT 'benchmark tables', count(DISTINCT (pid, ordinal)) FROM tb WHERE bench"""


def _stored_graph(s, d):
    """A graph written, read again, and nodes merged into it."""
    path = fresh_path(s, "graph")
    sinks.write_graph(B.star_graph(s, d), path)
    g = sinks.read_graph(s, path)
    even = table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("arxiv_id"), F.lit("renamed").alias("title"), F.lit(None).cast("string").alias("published"))
    g = G.upsert(g, "Paper", even)
    changed = {"renamed": g.node("Paper").where("title = 'renamed' AND published IS NOT NULL AND abstract IS NOT NULL")}
    return _counts({k.lower(): v for k, v in {**g.nodes, **g.edges}.items()} | changed)


_named = lambda names: " UNION ALL ".join(f"SELECT '{n.removeprefix('n_')}' AS name, count(*) AS n FROM {n}" for n in names)
STORED_SQL = B.star_sql(_named([k for k in B.STAR_SQL if k not in ("items", "papers_")]) + " UNION ALL SELECT 'renamed', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0")


def _raw(s, d):
    return B.generated_lines(s, d).select("paper_id", "page_number", "ordinal", F.col("line").alias("text"), T.line_type(F.col("line")).alias("raw_type"))


def _route(s, d):
    """one extractor fails, the others go on, and what no extractor takes is counted."""

    def broken(raw: DataFrame) -> DataFrame:
        raise RuntimeError("no captions today")

    chosen = {k: v for k, v in router.EXTRACTORS.items() if k != ("equation",)} | {("caption",): broken}
    got = router.route_elements(_raw(s, d), fresh_path(s, "routed"), chosen)
    found = got.elements.groupBy(F.col("element_type").alias("what")).agg(F.count("*").alias("n"))
    told = s.createDataFrame([(e, 1) for e in got.errors], "what string, n long")
    return found.unionByName(told).unionByName(got.left.select(F.concat(F.lit("left: "), "kind").alias("what"), "n"))


def _route_pages(s, d):
    """the lines of one page for each paper, by layout and routing."""
    lines = B.generated_lines(s, d).groupBy("paper_id", "page_number").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
    got = router.extract_pages(lines, fresh_path(s, "pages"))
    return got.elements.groupBy("element_type").agg(F.count("*").alias("n"))


def _report(s, d):
    k = F.col("o_orderkey")
    papers = table(s, d, "orders").select(F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("paper_id"), F.when(k % 14 != 0, F.concat(F.lit("a"), k.cast("string"))).alias("arxiv_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("p/"), k.cast("string"))).alias("pdf_path"), F.when(k % 9 != 0, F.concat(F.lit("q/"), k.cast("string"))).alias("local_pdf_path"), F.when(k % 5 == 0, "failed").otherwise("downloaded").alias("download_status"))
    files = table(s, d, "orders").where("o_orderkey % 4 <> 0").select(F.explode(F.array(*[F.concat(F.lit(p), k.cast("string")) for p in ("p/", "q/")])).alias("path"))
    return router.route_report(papers, files)


REPORT_SQL = """WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 14 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN 'a' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS paper_id,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'p/' || o_orderkey WHEN o_orderkey % 9 <> 0 THEN 'q/' || o_orderkey END AS pdf_path FROM orders)
SELECT paper_id, pdf_path, CASE WHEN k % 5 = 0 THEN 'not downloaded' WHEN pdf_path IS NULL THEN 'no path' WHEN k % 4 = 0 THEN 'missing file' ELSE 'routed' END AS status FROM t"""


def _found_papers(s, d):
    """Nations as what a search has found."""
    name = F.col("n_name")
    return table(s, d, "nation").select(
        F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("arxiv_id"), F.concat(F.lit(" On\n"), name, F.lit(" ")).alias("title"), F.array_repeat(name, (F.col("n_nationkey") % 4).cast("int")).alias("authors"),
        F.concat(name, F.lit("\nand more")).alias("abstract"), F.lit("2024-02-03T00:00:00").alias("published"), F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("primary_category"), F.when(F.col("n_nationkey") % 3 == 0, "downloaded").when(F.col("n_nationkey") % 3 == 1, "failed").otherwise("pending").alias("download_status"),
    )


def _cache(s, d):
    """A search's result cached, read again by its key, cleaned and listed."""
    folder = fresh_path(s, "search")
    sinks.write_search_cache(_found_papers(s, d), folder, "Graph Nets", 25)
    found = sources.clean_records(sources.cached_search(s, folder, "Graph Nets", 25))
    return sources.listing(found, [F.col("arxiv_id")])


CACHE_SQL = """SELECT CAST(row_number() OVER (ORDER BY 'n/' || n_nationkey) AS INTEGER) AS index, 'n/' || n_nationkey AS arxiv_id, 'On ' || n_name AS title,
 CASE n_nationkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN n_name ELSE n_name || ' +' || (n_nationkey % 4 - 1) END AS author, 'c' || n_regionkey AS category, '2024-02-03' AS day FROM nation"""


def _batches(s, d):
    """Both kinds of batch written and read again, one paper fetched, and what is downloaded told from the files."""
    papers, found = _found_papers(s, d), []
    for kind, batch in (("search", sinks.search_batch(papers, "now")), ("download", sinks.download_batch(papers))):
        path = fresh_path(s, "batch")
        batch.write.text(path)
        found.append(sources.read_batch(s, path).withColumn("kind", F.lit(kind)))
    both = found[0].unionByName(found[1])
    files = papers.select(N.pdf_filename(F.col("arxiv_id")).alias("name"), F.length("title").cast("long").alias("length"), (F.length("title") % 2 == 0).alias("valid")).where("length % 3 <> 0")
    told = sources.download_status(both.withColumn("pdf_name", N.pdf_filename(F.col("arxiv_id"))), files)
    one = sources.fetch_by_id(both, "n/7").select("kind", F.lit("fetched").alias("download_status"), F.lit(1).cast("long").alias("n"))
    return told.groupBy("kind", "download_status").agg(F.count("*").alias("n")).unionByName(one)


BATCH_SQL = """WITH p AS (SELECT length(n_name) + 5 AS l FROM nation), s AS (SELECT CASE WHEN l % 3 = 0 THEN 'pending' WHEN l % 2 = 0 THEN 'downloaded' ELSE 'failed' END AS download_status FROM p)
SELECT kind, download_status, count(*) AS n FROM s CROSS JOIN (VALUES ('search'), ('download')) k(kind) GROUP BY 1, 2 UNION ALL SELECT kind, 'fetched', 1 FROM (VALUES ('search'), ('download')) k(kind)"""


def _extractions(s, d):
    """An extraction of each region's nations written as JSON in a folder of its own, and read again."""
    folder = fresh_path(s, "extracted")
    element = F.struct(F.lit("text").alias("element_type"), F.col("n_name").alias("content"), F.col("n_nationkey").cast("int").alias("page_number"))
    made = table(s, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("paper_id")).agg(F.collect_list(element).alias("elements"), F.array(F.lit("one error")).alias("errors"))
    for r in made.select("paper_id").collect():  # a region each
        one = made.where(F.col("paper_id") == r["paper_id"]).coalesce(1)
        one.write.json(f"{folder}/{r['paper_id']}")
    read = s.read.schema(sources.EXTRACTION).option("recursiveFileLookup", True).json(folder).where("paper_id IS NOT NULL")
    return read.select("paper_id", F.explode("elements").alias("e"), F.size("errors").alias("errors")).groupBy("paper_id").agg(F.count("*").alias("elements"), F.sum("e.page_number").alias("pages"), F.min("e.content").alias("first"), F.max("errors").alias("errors"))


def _pdf_report(s, d):
    k = F.col("o_orderkey")
    files = table(s, d, "orders").select(N.pdf_filename(k.cast("string")).alias("name"), (k * 1024).cast("long").alias("length"), (k % 3 != 0).alias("valid"))
    return sinks.pdf_report(files).withColumn("names", F.array_join("names", "|"))


def _parts(s, d):
    text = F.concat(F.lit("as \\[x^{"), F.col("p_partkey").cast("string"), F.lit("}\\] says [a_{i} = "), F.col("p_size").cast("string"), F.lit("] but [see the notes below] "), F.col("p_name"))
    return table(s, d, "part").select("p_partkey", F.posexplode(R.answer_parts(text)).alias("at", "part")).select("p_partkey", "at", "part.latex", "part.text")


PARTS_SQL = r"""WITH p AS (SELECT p_partkey, ['as ', '\[x^{' || p_partkey || '}\]', ' says ', '[a_{i} = ' || p_size || ']', ' but ', '[see the notes below]', ' ' || p_name] AS t FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS at, i IN (1, 3) AS latex, t[i + 1] AS text FROM p, (SELECT unnest(range(7)) AS i)"""


def _groups(s, d):
    rows = table(s, d, "nation").select("n_regionkey", "n_name", "n_nationkey")
    return R.first_seen_groups(rows, "n_regionkey", "n_name", [F.desc("n_nationkey")]).withColumn("values", F.array_join("values", "|"))


GROUPS_SQL = """WITH g AS (SELECT n_regionkey, max(n_nationkey) AS top, string_agg(n_name, '|' ORDER BY n_nationkey DESC) AS values FROM nation GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY top DESC) AS INTEGER) AS place, n_regionkey, values FROM g"""


def _kinds(s, d):
    return B.generated_lines(s, d).select("paper_id", T.raw_type_kind(T.line_type(F.col("line"))).alias("element_type"), F.col("line").alias("content"))


def _asked(s, d):
    """What a question about tables retrieves, with the sources that an answer names."""
    g = B.star_graph(s, d)
    got = R.ask(g, "accuracy numbers")
    rows = R.retrieve(g, "accuracy numbers")
    told = rows.groupBy("title").agg(F.count("*").alias("n"))
    return told.join(s.createDataFrame([(x,) for x in got["sources"]], "title string").groupBy("title").agg(F.count("*").alias("named")), "title", "left")


ASKED_SQL = "SELECT title, count(*) AS n, count(*) AS named FROM (SELECT p.title FROM n_paper p JOIN has_table h ON h.src = p.arxiv_id JOIN n_table t ON h.dst = t.element_id WHERE t.is_benchmark ORDER BY p.published DESC, t.page_number, p.arxiv_id, t.element_id LIMIT 1000) GROUP BY 1"

QUERIES = {
    "build_graph": _build_graph,
    "stored_graph": _stored_graph,
    "route_elements": _route,
    "route_pages": _route_pages,
    "route_report": _report,
    "search_cache_round_trip": _cache,
    "batch_round_trip": _batches,
    "extraction_round_trip": _extractions,
    "pdf_report": _pdf_report,
    "answer_parts": _parts,
    "first_seen_groups": _groups,
    "element_summary": lambda s, d: X.element_summary(_kinds(s, d)),
    "raw_type_counts": lambda s, d: X.raw_type_counts(_raw(s, d)),
    "ask_sources": _asked,
    "rich_content": lambda s, d: R.rich_content(B.star_graph(s, d), "which TABLE compares them")[1],
    "retrieve_papers": lambda s, d: R.retrieve(B.star_graph(s, d), "hello", 7).select("arxiv_id", "title", "published", F.size("methods").cast("long").alias("methods")),
}
