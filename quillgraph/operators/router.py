"""Routing of raw elements and papers to extractors."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import extract as X

Extractor = Callable[[DataFrame], DataFrame]
ELEMENT = ("paper_id", "element_type", "page_number", "content")


def _texts(raw: DataFrame) -> DataFrame:
    return X.text_elements(raw)


def _equations(raw: DataFrame) -> DataFrame:
    return X.equation_elements(raw).withColumn("element_type", F.lit("equation")).withColumnRenamed("latex", "content")


def _captions(raw: DataFrame) -> DataFrame:
    return raw.withColumn("element_type", F.lit("caption")).withColumn("content", T.py_strip(F.col("text")))


def _tables(raw: DataFrame) -> DataFrame:
    """Tables with markup of their own (`html`); others have nothing to parse."""
    rows = raw.withColumn("rows", X.html_rows(F.col("html")) if "html" in raw.columns else F.array().cast("array<array<string>>"))
    rows = rows.select("paper_id", "page_number", "ordinal", "rows")
    return X.table_elements(rows, rows.limit(0)).withColumn("element_type", F.lit("table"))


#: The kinds that each extractor takes. Figures need images, so they have none by default.
EXTRACTORS: dict[tuple[str, ...], Extractor] = {("text", "title"): _texts, ("equation",): _equations, ("caption",): _captions, ("table",): _tables}


@dataclass
class Routed:
    """elements: what was extracted, as ELEMENT; errors: one text for each extractor that failed; left: how many raw elements no extractor takes, by kind."""

    elements: DataFrame
    errors: list[str] = field(default_factory=list)
    left: DataFrame | None = None


def route_elements(raw: DataFrame, path: str, extractors: Mapping[tuple[str, ...], Extractor] = EXTRACTORS) -> Routed:
    """raw elements by kind to one extractor each, whose elements are written below `path`.

    An extractor that fails, when it is planned or when it runs, is told in `errors` and leaves no elements; the others go on.
    """
    told = raw.withColumn("_kind", T.raw_type_kind(F.col("raw_type")))
    found, errors = [], []
    for kinds, extract in extractors.items():
        mine, to = told.where(F.col("_kind").isin(*kinds)).drop("_kind"), f"{path}/{'-'.join(kinds)}"
        try:
            extract(mine).select("paper_id", "element_type", F.col("page_number").cast("int").alias("page_number"), "content").write.mode("overwrite").parquet(to)
        except Exception as why:  # whatever stops one extractor must not stop the others
            errors.append(f"{'/'.join(kinds)}: {type(why).__name__}: {str(why).splitlines()[0] if str(why) else ''}")
        else:
            found.append(raw.sparkSession.read.parquet(to))
    none = raw.sparkSession.createDataFrame([], "paper_id string, element_type string, page_number int, content string")
    taken = [k for kinds in extractors for k in kinds]
    left = told.where(~F.col("_kind").isin(*taken)).groupBy(F.col("_kind").alias("kind")).agg(F.count("*").alias("n"))
    return Routed(reduce(DataFrame.unionByName, found, none), errors, left)


def extract_pages(pages: DataFrame, path: str, detector: Extractor | None = None, extractors: Mapping[tuple[str, ...], Extractor] = EXTRACTORS) -> Routed:
    """layout, then routing."""
    return route_elements(X.detect_layout(pages, detector), path, extractors)


def route_report(papers: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(paper_id, pdf_path, status): routed, or why a paper is skipped: not downloaded, no path, missing file. files: the paths there are."""
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs if c in papers.columns], F.lit(None).cast("string"))
    told = papers.withColumn("_id", F.coalesce(filled("paper_id", "arxiv_id"), F.lit("unknown"))).withColumn("_path", filled("pdf_path", "local_pdf_path"))
    there = F.lit(True)
    if files is not None:
        told = told.join(files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct(), "_path", "left")
        there = F.coalesce("_there", F.lit(False))
    downloaded = F.col("download_status").eqNullSafe("downloaded") if "download_status" in papers.columns else F.lit(True)
    status = F.when(~downloaded, "not downloaded").when(F.col("_path").isNull(), "no path").when(~there, "missing file").otherwise("routed")
    return told.select(F.col("_id").alias("paper_id"), F.col("_path").alias("pdf_path"), status.alias("status"))
