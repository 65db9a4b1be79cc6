"""Column functions for names and labels: cache keys, files, authors, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(query: Column, most: Column) -> Column:
    """The file name under which a search is cached."""
    readable = F.lower(F.replace(F.substring(query, 1, 40), F.lit(" "), F.lit("_")))
    return F.concat(readable, F.lit("_"), F.substring(F.md5(F.concat_ws("|", query, most.cast("string"))), 1, 10), F.lit(".json"))


def pdf_filename(paper_id: Column) -> Column:
    """S10."""
    return F.concat(F.replace(paper_id, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def valid_pdf(content: Column) -> Column:
    """At least 10,000 bytes that begin with %PDF-."""
    return F.coalesce((F.octet_length(content) >= 10_000) & (F.substring(content, 1, 5) == F.lit(b"%PDF-")), F.lit(False))


def author_label(authors: Column) -> Column:
    """The first author and how many more; Unknown if there are none."""
    n = F.size(authors)
    return F.when(n <= 0, "Unknown").when(n == 1, F.get(authors, F.lit(0))).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" +"), (n - 1).cast("string")))


def author_list(authors: Column) -> Column:
    """Up to three authors, then et al."""
    return F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))


def ellipsis(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def preview(text: Column, most: int = 60) -> Column:
    """The start of an element on one line."""
    return F.replace(F.substring(text, 1, most), F.lit("\n"), F.lit(" "))


def element_id(*parts: Column) -> Column:
    """A label of twelve hex digits that depend on the parts alone. No key: its 48 bits repeat among tens of millions of elements."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def sidecar(kind: str, number: Column, page: Column, extension: str = "json") -> Column:
    """K5-K7: names such as table_001_p4.json."""
    return F.format_string(f"{kind}_%03d_p%d.{extension}", number.cast("int"), page.cast("int"))


def crop_box(bbox: Column, width: Column, height: Column, dpi: int = 200, pad: int = 10) -> Column:
    """The pixels of a region (in points, of a page of that width and height) with a margin, within its page; null if nothing is left."""
    pixels = lambda points: F.floor(points * (dpi / 72.0)).cast("int")
    w, h = pixels(width), pixels(height)
    at = lambda i, points, most: F.floor(F.get(bbox, F.lit(i)) / points * most).cast("int")
    x0, y0 = F.greatest(F.lit(0), at(0, width, w) - pad), F.greatest(F.lit(0), at(1, height, h) - pad)
    x1, y1 = F.least(w, at(2, width, w) + pad), F.least(h, at(3, height, h) + pad)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def box_of(xs: Column, ys: Column) -> Column:
    """The bounding box of a polygon."""
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
