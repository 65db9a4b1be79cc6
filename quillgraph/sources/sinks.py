"""Writers: batches as one JSON document, elements by paper, node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import cache_key
from ..operators.graph import EDGES, KEYS, Graph


def search_batch(papers: DataFrame, timestamp: str) -> DataFrame:
    """K1: one row with a document (query_timestamp, count, papers). A batch is one search's result, 100 papers at most."""
    return papers.agg(F.to_json(F.struct(F.lit(timestamp).alias("query_timestamp"), F.count("*").alias("count"), F.sort_array(F.collect_list(F.struct("arxiv_id", *[c for c in papers.columns if c != "arxiv_id"]))).alias("papers"))).alias("value"))


def download_summary(papers: DataFrame) -> DataFrame:
    """How many papers there are, are downloaded and failed."""
    return papers.agg(F.count("*").alias("count"), F.count_if(F.col("download_status") == "downloaded").alias("downloaded"), F.count_if(F.col("download_status") == "failed").alias("failed"))


def download_batch(papers: DataFrame) -> DataFrame:
    """K2 whole: one row with a document (count, downloaded, failed, papers). A batch is one search's result, 100 papers at most."""
    of = lambda status: F.count_if(F.col("download_status") == status).alias(status)
    listed = F.sort_array(F.collect_list(F.struct("arxiv_id", *[c for c in papers.columns if c != "arxiv_id"]))).alias("papers")
    return papers.agg(F.to_json(F.struct(F.count("*").alias("count"), of("downloaded"), of("failed"), listed)).alias("value"))


def pdf_report(files: DataFrame, first: int = 10) -> DataFrame:
    """A10: number and megabytes of valid files, and the first names."""
    names = files.where("valid").select("name").orderBy("name").limit(first).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return files.where("valid").agg(F.count("*").alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("mb")).crossJoin(names)  # one row each


def write_search_cache(papers: DataFrame, folder: str, query: str, most: int) -> str | None:
    """K3: the papers of a search under its cache key, one JSON object a line; nothing is written for none. Returns where."""
    if papers.isEmpty():
        return None
    name = papers.sparkSession.range(1).select(cache_key(F.lit(query), F.lit(most)).alias("n")).first()["n"]
    papers.write.mode("overwrite").json(f"{folder}/{name}")
    return f"{folder}/{name}"


def write_extractions(elements: DataFrame, path: str) -> None:
    """K4: a folder for each paper."""
    elements.write.mode("overwrite").partitionBy("paper_id").json(path)


def write_graph(graph: Graph, path: str) -> None:
    """A Parquet table for each label and type of edge."""
    for name, df in [*graph.nodes.items(), *graph.edges.items()]:
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark, path: str, labels: list[str] | None = None, types: list[str] | None = None) -> Graph:
    """The stored tables; by default all that there are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    read = lambda names: {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return Graph(spark, read([n for n in KEYS if n in there] if labels is None else labels), read([t for t in EDGES if t in there] if types is None else types))
