"""Chapters of books from several kinds of evidence, and the editing of what was found.

Evidence per line: its words, its looks, entries of a table of contents that name it. The
first good line of a page is its anchor; anchors become nodes, nodes get ranges, nodes that
share a beginning form parts. Everything is partitioned by book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import layout as lo
from . import lines as ln

#: fixed values: confidence from which a line is a heading, and under which it is to be reviewed
HEADING, REVIEW = 0.45, 0.8


def candidates(paged: DataFrame, least: float = HEADING) -> DataFrame:
    """source, page_number, line_no, label, words, looks, confidence of the lines that may be headings."""
    lines = ln.lines(paged).select("source", "page_number", "line_no", t.collapse_blanks("line").alias("label")).where("label <> '' AND length(label) <= 80")
    c = lines.withColumns({"words": t.lexical_score("label"), "looks": t.typographic_score("label", F.lit(0.0), F.lit(0.0))})
    return c.withColumn("confidence", F.round(F.greatest("words", "looks"), 4)).where(F.col("confidence") >= least)


def anchors(found: DataFrame) -> DataFrame:
    """The first candidate of each page."""
    best = F.min_by(F.struct("line_no", "label", "confidence"), "line_no")
    return found.groupBy("source", "page_number").agg(best.alias("a")).select("source", "page_number", "a.*")


def nodes(paged: DataFrame, least: float = HEADING) -> DataFrame:
    """Nodes of each book: kind, titles, range, confidence, status, ordinal from 0."""
    total = paged.groupBy("source").agg(F.max("page_number").alias("total"))
    a = anchors(candidates(paged, least)).join(total, "source").withColumnRenamed("page_number", "start_page")
    n = lo.closed_ranges(a, ["source"], "start_page", F.col("total"))
    ordinal = F.row_number().over(Window.partitionBy("source").orderBy("start_page")) - 1
    return n.select("source", ordinal.cast("bigint").alias("ordinal"), t.node_kind("label").alias("kind"), F.col("label").alias("source_label"), t.normal_title("label").alias("normalized_title"), "start_page", "end_page", F.col("confidence"), F.when(F.col("confidence") < REVIEW, "needs_review").otherwise("proposed").alias("status"))


def verified_toc(entries: DataFrame, paged: DataFrame) -> DataFrame:
    """entries(source, title, page) with verified: does a line of the page equal the title, or hold it and name a part of a book?"""
    lines = ln.lines(paged).select("source", F.col("page_number").alias("page"), F.lower(t.collapse_blanks("line")).alias("line"))
    title = F.lower(t.collapse_blanks("title"))
    j = entries.join(lines, ["source", "page"], "left")
    hit = (F.col("line") == title) | (F.col("line").contains(title) & t.is_structural("line"))
    return j.groupBy("source", "title", "page").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("verified"))


def page_windows(items: DataFrame, pages: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """items(item_id, text), pages(page, text) -> item_id, page, window: the longest of the item's first 12, 8, 6 or 4
    words that stand on the page in a row, across lines; items of fewer than four words are sought whole.
    ranges(item_id, start_page, end_page) leaves each item the pages of its chapter only."""
    low = lambda c: t.words(F.lower(c))
    lead = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    i = items.select("item_id", low("text").alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(4)))
    i = i.select("item_id", "n", lead("w", 1, F.col("n")).alias("lead"), F.slice("w", 1, 12).alias("w")).distinct()
    x = pages.select("page", low("text").alias("v")).where("size(v) > 0")
    x = x.select("page", "v", F.posexplode("v").alias("at", "_")).select("page", F.slice("v", F.col("at") + 1, 12).alias("v"))
    x = x.join(F.broadcast(i.select("n").distinct())).where(F.size("v") >= F.col("n"))
    j = x.withColumn("lead", lead("v", 1, F.col("n"))).join(i, ["n", "lead"])
    if ranges is not None:
        j = j.join(ranges, "item_id").where("page BETWEEN start_page AND end_page")
    hit = lambda k: (F.size("w") >= k) & (F.slice("v", 1, k) == F.slice("w", 1, k))
    window = F.when(hit(12), 12).when(hit(8), 8).when(hit(6), 6).otherwise(F.col("n"))
    return j.groupBy("item_id", "page").agg(F.max(window).alias("window"))


def parts(chapters: DataFrame, least: int = 4) -> DataFrame:
    """Runs of `least` or more chapters whose titles begin with the same word: source, first, last, prefix, chapters."""
    w = Window.partitionBy("source").orderBy("start_page")
    head = F.substring_index(F.col("normalized_title"), " ", 1)
    c = chapters.withColumn("head", head).withColumn("fresh", ~F.col("head").eqNullSafe(F.lag("head").over(w)))
    c = c.withColumn("run", F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(w))
    return c.groupBy("source", "run").agg(F.min("start_page").alias("first"), F.max("end_page").alias("last"), F.first("head").alias("prefix"), F.count("*").alias("chapters")).where(F.col("chapters") >= least).drop("run")


def moved_boundary(n: DataFrame, source: str, ordinal: int, start: int) -> DataFrame:
    """Nodes with one start moved; the ranges around it close again."""
    hit = (F.col("source") == source) & (F.col("ordinal") == ordinal)
    total = n.groupBy("source").agg(F.max("end_page").alias("total"))
    m = n.withColumn("start_page", F.when(hit, F.lit(start)).otherwise(F.col("start_page"))).drop("end_page").join(total, "source")
    return lo.closed_ranges(m, ["source"], "start_page", F.col("total")).drop("total")


def merged_nodes(n: DataFrame, source: str, ordinal: int) -> DataFrame:
    """Nodes with one taken into the one before it; ordinals close up."""
    gone = (F.col("source") == source) & (F.col("ordinal") == ordinal)
    end = F.lead("end_page").over(Window.partitionBy("source").orderBy("ordinal"))
    before = (F.col("source") == source) & (F.col("ordinal") == ordinal - 1)
    m = n.withColumn("end_page", F.when(before, end).otherwise(F.col("end_page"))).where(~gone)
    return m.withColumn("ordinal", (F.row_number().over(Window.partitionBy("source").orderBy("ordinal")) - 1).cast("bigint"))


def split_node(n: DataFrame, source: str, ordinal: int, page: int, label: str) -> DataFrame:
    """Nodes with one cut at a page; later ordinals move on."""
    hit = (F.col("source") == source) & (F.col("ordinal") == ordinal) & (F.col("start_page") < page) & (F.col("end_page") >= page)
    cut = n.where(hit)
    later = (F.col("source") == source) & (F.col("ordinal") > ordinal)
    rest = n.join(cut.select("source").distinct().withColumn("cut", F.lit(True)), "source", "left")
    rest = rest.withColumns({"end_page": F.when(hit, F.lit(page - 1)).otherwise(F.col("end_page")), "ordinal": F.col("ordinal") + F.when(later & F.col("cut").isNotNull(), 1).otherwise(0)}).drop("cut")
    new = cut.withColumns({"ordinal": F.col("ordinal") + 1, "start_page": F.lit(page).cast(n.schema["start_page"].dataType), "source_label": F.lit(label), "normalized_title": t.normal_title(F.lit(label))})
    return rest.select(*n.columns).unionByName(new.select(*n.columns))


def kept_or_replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals replaced by new ones; confirmed rows stay and win over a new one of the same key."""
    confirmed = old.where("status = 'confirmed'")
    return confirmed.unionByName(new.join(confirmed.select(*keys), keys, "left_anti"))
