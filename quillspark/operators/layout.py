"""Pages, repeated headers, chapters and their ranges.

A book is the documents of one source in the order of their ids; a document is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import lines as ln
from . import ranking as rk


def pages(docs: DataFrame) -> DataFrame:
    """source, page_number, doc_id and the other columns of docs."""
    return rk.numbered(docs, ["source"], [F.col("doc_id")], "page_number")


def header_census(docs: DataFrame, share: float, least: int = 2) -> DataFrame:
    """Lines that repeat, by key: occurrences in a book of at least `share` of its pages."""
    total = docs.groupBy("source").agg(F.count("*").alias("pages"))
    keys = ln.lines(docs).select("source", t.line_key("line").alias("line_key")).where("line_key <> ''")
    counts = keys.groupBy("source", "line_key").agg(F.count("*").alias("occurrences"))
    return counts.join(total, "source").where(F.col("occurrences") >= F.greatest(F.lit(least), F.ceil(share * F.col("pages")))).select("source", "line_key", "occurrences")


def confirmed_headers(census: DataFrame, docs: DataFrame, share: float, least: int = 2) -> DataFrame:
    """Of the census: keys of digits and marks alone always, others from the floor of `share` of the pages."""
    total = docs.groupBy("source").agg(F.count("*").alias("pages"))
    marks = F.col("line_key").rlike(r"^[#\s\-–—.,()\[\]]+$")
    enough = F.col("occurrences") >= F.greatest(F.lit(least), F.floor(share * F.col("pages")))
    return census.join(total, "source").where(marks & (F.col("occurrences") >= least) | enough).select("source", "line_key", "occurrences")


def continuous_headers(paged: DataFrame, span: float, density: float) -> DataFrame:
    """Keys that run through a book: first to last page over `span` of it, on `density` of the pages between."""
    total = paged.groupBy("source").agg(F.max("page_number").alias("total"))
    keys = ln.lines(paged).select("source", "page_number", t.line_key("line").alias("line_key")).where("line_key <> ''").distinct()
    runs = keys.groupBy("source", "line_key").agg(F.count("*").alias("on_pages"), F.min("page_number").alias("first"), F.max("page_number").alias("last"))
    runs = runs.join(total, "source").withColumn("reach", F.col("last") - F.col("first") + 1)
    return runs.where((F.col("on_pages") > 1) & (F.col("reach") >= span * F.col("total")) & (F.col("on_pages") >= density * F.col("reach"))).select("source", "line_key", "on_pages", "first", "last")


def closed_ranges(nodes: DataFrame, keys: list[str], start: str, last: Column) -> DataFrame:
    """nodes with end_page: the page before the next node's start, the book's last for the last; never before the start."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return nodes.withColumn("end_page", F.greatest(F.col(start), F.coalesce(nxt - 1, last)))


def offsets(paged: DataFrame) -> DataFrame:
    """source, page_number, doc_id, start_char and end_char of the pages in a book joined by line feeds."""
    size = F.length("text").cast("long")
    ends = rk.running_total(paged.select("source", "page_number", "doc_id", size.alias("size")), ["source"], [F.col("page_number")], F.col("size") + 1, "end")
    return ends.select("source", "page_number", "doc_id", (F.col("end") - F.col("size") - 1).alias("start_char"), (F.col("end") - 1).alias("end_char"))


def toc_entries(paged: DataFrame, first: int, least: int) -> DataFrame:
    """Entries of pages of contents: lines that end in leaders and a page number, on pages with `least` of them."""
    pattern = r"^(.+?)[\s.‥…_]{2,}(\d{1,4})$"
    e = ln.lines(paged.where(F.col("page_number") <= first)).where(F.col("line").rlike(pattern))
    e = e.select("source", "page_number", "line_no", F.rtrim(F.regexp_extract("line", pattern, 1)).alias("title"), F.regexp_extract("line", pattern, 2).cast("int").alias("page"))
    n = e.groupBy("source", "page_number").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return e.join(n, ["source", "page_number"]).drop("n")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, para_no, kind, lines, text: lines joined until a quotation opens or a scene breaks."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = ln.lines(docs).withColumn("line", t.strip("line")).where("line <> ''")
    scene = t.is_scene_break("line")
    quote = F.substring("line", 1, 1).isin(*t.QUOTE_OPENERS, "'")
    fresh = quote | scene | F.coalesce(F.lag(scene).over(w), F.lit(True))
    g = rk.islands(lines.withColumn("fresh", fresh), ["doc_id"], ["line_no"], F.col("fresh"), "para_no")
    g = g.groupBy("doc_id", "para_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    one = F.col("l.line")
    verse = (F.size("l") >= 2) & F.forall(one, lambda x: F.length(x) <= 42)
    text = F.when(verse, F.array_join(one, "\n")).otherwise(t.collapse_blanks(F.array_join(one, " ")))
    return g.select("doc_id", "para_no", t.paragraph_kind(text).alias("kind"), F.size("l").cast("long").alias("lines"), text.alias("text"), verse.alias("is_verse"))
