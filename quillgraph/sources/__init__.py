"""Readers: search caches, batches, extractions, PDF files, driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import author_label, cache_key, ellipsis, valid_pdf
from ..functions.text import py_strip

PAPER = "arxiv_id string, title string, authors array<string>, abstract string, categories array<string>, published string, updated string, pdf_url string, entry_url string, primary_category string, comment string, doi string, journal_ref string, local_pdf_path string, download_status string"
ELEMENT = "element_type string, content string, paper_id string, element_id string, page_number int, bbox array<double>, metadata string"
EXTRACTION = f"paper_id string, pdf_path string, timestamp string, stats map<string,int>, errors array<string>, elements array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>"


def read_search_cache(spark: SparkSession, path: str) -> DataFrame:
    """Files with a JSON array of papers, or what write_search_cache wrote."""
    return spark.read.schema(PAPER).option("multiLine", not path.endswith(".json") or _is_file(spark, path)).json(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Files with a list of papers, or an object whose `papers` is one."""
    both = spark.read.schema(f"{PAPER}, papers array<struct<{PAPER.replace(', ', ',').replace(' ', ':')}>>").option("multiLine", True).json(path)
    inner = both.where("papers IS NOT NULL").select(F.explode("papers").alias("p")).select("p.*")
    return both.where("papers IS NULL").drop("papers").unionByName(inner)


def cached_search(spark: SparkSession, folder: str, query: str, most: int) -> DataFrame:
    """S1 offline: the cached result of a search."""
    name = spark.range(1).select(cache_key(F.lit(query), F.lit(most)).alias("n")).first()["n"]
    return read_search_cache(spark, f"{folder}/{name}")


def fetch_by_id(papers: DataFrame, arxiv_id: str) -> DataFrame:
    """S2."""
    return papers.where(F.col("arxiv_id") == arxiv_id)


def clean_records(records: DataFrame) -> DataFrame:
    """S3: titles and abstracts on one line, stripped."""
    one_line = lambda c: py_strip(F.replace(F.col(c), F.lit("\n"), F.lit(" ")))
    return records.withColumns({c: one_line(c) for c in ("title", "abstract")})


def read_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """Every extraction.json below a folder; unreadable files are skipped."""
    found = spark.read.schema(EXTRACTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "extraction.json").json(folder)
    return found.where("paper_id IS NOT NULL")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, valid) of files; contents aren't kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", valid_pdf(F.col("content")).alias("valid"))


def download_status(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers (with pdf_name) against files (name, length, valid) there are."""
    told = papers.join(files.select(F.col("name").alias("pdf_name"), "length", "valid"), "pdf_name", "left")
    status = F.when(F.col("valid"), "downloaded").when(F.col("length").isNotNull(), "failed").otherwise("pending")
    return told.withColumn("download_status", status).drop("length", "valid")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S21."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(papers: DataFrame, order: list[Column]) -> DataFrame:
    """The numbered lines of a search's result (100 papers at most): id, title, first author and how many more, category, day."""
    number = F.row_number().over(Window.orderBy(*order))
    return papers.select(number.alias("index"), "arxiv_id", ellipsis(F.col("title")).alias("title"), author_label(F.col("authors")).alias("author"), F.col("primary_category").alias("category"), F.substring("published", 1, 10).alias("day"))
