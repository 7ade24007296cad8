"""Queries over pages, headers, chapters and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as t
from ..operators import joins as jn
from ..operators import layout as lo
from ..operators import lines as ln
from ..session import table
from .texts import LINES

PAGED = "paged AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents)"
KEY = r"trim(regexp_replace(regexp_replace(line, '\d', '#', 'g'), '[ \t\x{00a0}]+', ' ', 'g'))"
#: chapters of the stand-in books begin on pages whose text opens with a vowel
NODES = "nodes AS (SELECT source, page_number AS start_page FROM paged WHERE regexp_matches(text, '^[AEIOU]')), total AS (SELECT source, max(page_number) AS total FROM paged GROUP BY source), ranges AS (SELECT source, start_page, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY source ORDER BY start_page) - 1, total)) AS end_page FROM nodes JOIN total USING (source))"


def _ranges(paged):
    total = paged.groupBy("source").agg(F.max("page_number").alias("total"))
    nodes = paged.where(F.col("text").rlike("^[AEIOU]")).select("source", F.col("page_number").alias("start_page")).join(total, "source")
    return lo.closed_ranges(nodes, ["source"], "start_page", F.col("total")).select("source", "start_page", "end_page")


@query(f"""WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), k AS (SELECT source, {KEY} AS line_key, count(*) AS occurrences FROM lines GROUP BY source, {KEY})
SELECT source, line_key, occurrences FROM k JOIN p USING (source) WHERE line_key <> '' AND occurrences >= greatest(2, ceil(0.04 * pages))""")
def header_census(spark, sf):
    return lo.header_census(table(spark, sf, "documents"), 0.04)


@query(f"""WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), k AS (SELECT source, {KEY} AS line_key, count(*) AS occurrences FROM lines GROUP BY source, {KEY})
SELECT source, line_key, occurrences FROM k JOIN p USING (source) WHERE line_key <> '' AND occurrences >= greatest(2, ceil(0.02 * pages)) AND (occurrences >= 2 AND regexp_matches(line_key, '^[#\\s\\-–—.,()\\[\\]]+$') OR occurrences >= greatest(2, floor(0.06 * pages)))""")
def header_confirm(spark, sf):
    d = table(spark, sf, "documents")
    return lo.confirmed_headers(lo.header_census(d, 0.02), d, 0.06)


@query(f"""WITH {PAGED}, total AS (SELECT source, max(page_number) AS total FROM paged GROUP BY source),
l AS (SELECT source, page_number, unnest(string_split(text, chr(10))) AS line FROM paged), k AS (SELECT DISTINCT source, page_number, {KEY} AS line_key FROM l),
r AS (SELECT source, line_key, count(*) AS on_pages, min(page_number) AS first, max(page_number) AS last FROM k WHERE line_key <> '' GROUP BY source, line_key)
SELECT source, line_key, on_pages, first, last FROM r JOIN total USING (source) WHERE on_pages > 1 AND last - first + 1 >= 0.3 * total AND on_pages >= 0.05 * (last - first + 1)""")
def header_continuity(spark, sf):
    return lo.continuous_headers(lo.pages(table(spark, sf, "documents")), 0.3, 0.05)


@query(f"WITH {PAGED}, {NODES} SELECT * FROM ranges")
def range_close(spark, sf):
    return _ranges(lo.pages(table(spark, sf, "documents")))


@query(f"""WITH {PAGED} SELECT source, page_number, doc_id, CAST(sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - len(text) - 1 AS BIGINT) AS start_char,
  CAST(sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - 1 AS BIGINT) AS end_char FROM paged""")
def page_offsets(spark, sf):
    return lo.offsets(lo.pages(table(spark, sf, "documents")))


@query(f"""WITH {PAGED}, o AS (SELECT source, page_number, sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - len(text) - 1 AS a, sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - 1 AS z FROM paged),
m AS (SELECT event_id, 'src' || (user_id % 20) AS source, event_id * 11 AS at FROM events)
SELECT event_id, o.page_number FROM m JOIN o ON m.source = o.source AND m.at BETWEEN o.a AND o.z""")
def offset_to_page(spark, sf):
    o = lo.offsets(lo.pages(table(spark, sf, "documents"))).drop("doc_id")
    m = table(spark, sf, "events").select("event_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), (F.col("event_id") * 11).alias("at"))
    return jn.range_join(m, o, ["source"], "at", "start_char", "end_char", 1 << 14).select("event_id", "page_number")


@query(f"WITH {PAGED}, {NODES} SELECT doc_id, start_page AS chapter FROM paged p JOIN ranges r ON p.source = r.source AND page_number BETWEEN start_page AND end_page")
def page_to_chapter(spark, sf):
    p = lo.pages(table(spark, sf, "documents"))
    return jn.range_join(p.select("doc_id", "source", "page_number"), _ranges(p), ["source"], "page_number", "start_page", "end_page", 16).select("doc_id", F.col("start_page").alias("chapter"))


@query(f"WITH {PAGED}, {NODES} SELECT doc_id FROM paged p WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM ranges r WHERE p.source = r.source AND page_number BETWEEN start_page AND end_page)")
def uncovered_pages(spark, sf):
    p = lo.pages(table(spark, sf, "documents"))
    return jn.range_join(p.where(F.trim("text") != "").select("doc_id", "source", "page_number"), _ranges(p), ["source"], "page_number", "start_page", "end_page", 16, "left_anti").select("doc_id")


@query(f"WITH {PAGED}, {NODES} SELECT doc_id, (SELECT max(start_page) FROM nodes n WHERE n.source = p.source AND n.start_page <= p.page_number) AS chapter FROM paged p")
def scene_asof(spark, sf):
    p = lo.pages(table(spark, sf, "documents"))
    nodes = p.where(F.col("text").rlike("^[AEIOU]")).select("source", F.col("page_number").alias("start_page"), F.col("page_number").alias("chapter"))
    return jn.as_of(p.select("doc_id", "source", "page_number"), nodes, ["source"], "page_number", "start_page", "chapter", 16).select("doc_id", "chapter")


@query("""WITH q AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT l.l_orderkey, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM q WHERE q.l_orderkey = l.l_orderkey AND l.l_linenumber BETWEEN a AND z)""")
def quote_containment(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    q = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"))
    return jn.range_join(li.drop("l_returnflag"), q, ["l_orderkey"], "l_linenumber", "a", "z", 8, "left_semi")


@query("""WITH q AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS z FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT l.l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.l_orderkey = l.l_orderkey AND l.l_linenumber BETWEEN a AND z)""")
def uncovered_mentions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    q = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("z"))
    return jn.range_join(li.drop("l_returnflag"), q, ["l_orderkey"], "l_linenumber", "a", "z", 8, "left_anti")


@query(rf"""WITH {PAGED}, l AS (SELECT source, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM paged WHERE page_number <= 6),
e AS (SELECT source, page_number, line_no, rtrim(regexp_extract(line, '^(.+?)[\s.‥…_]{{2,}}(\d{{1,4}})$', 1), ' ') AS title, TRY_CAST(regexp_extract(line, '^(.+?)[\s.‥…_]{{2,}}(\d{{1,4}})$', 2) AS INTEGER) AS page FROM l WHERE regexp_matches(line, '^(.+?)[\s.‥…_]{{2,}}(\d{{1,4}})$'))
SELECT source, page_number, line_no, title, page FROM e WHERE (source, page_number) IN (SELECT (source, page_number) FROM e GROUP BY source, page_number HAVING count(*) >= 1)""")
def toc_pages(spark, sf):
    return lo.toc_entries(lo.pages(table(spark, sf, "documents")), 6, 1)


@query(rf"""WITH {LINES}, l AS (SELECT doc_id, line_no, trim(line) AS line FROM lines WHERE trim(line) <> ''),
f AS (SELECT *, regexp_matches(line, '^[*#•.\s~\-—–]{{3,}}$') AS scene FROM l),
g AS (SELECT *, CASE WHEN line[1] IN ('“', '"', '«', '‘', '’', '”', '''') OR scene OR coalesce(lag(scene) OVER (PARTITION BY doc_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM g)
SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, count(*) AS lines, count(*) >= 2 AND max(len(line)) <= 42 AS is_verse,
  CASE WHEN count(*) >= 2 AND max(len(line)) <= 42 THEN string_agg(line, chr(10) ORDER BY line_no) ELSE trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no), '[ \t\x{{00a0}}]+', ' ', 'g')) END AS text FROM h GROUP BY doc_id, para_no""")
def para_islands(spark, sf):
    return lo.paragraphs(table(spark, sf, "documents")).select("doc_id", "para_no", "lines", "is_verse", "text")


@query(rf"""WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^([*#•·]\s*){{2,}}$')) AS separators, count(*) FILTER (NOT regexp_matches(trim(line), '^([*#•·]\s*){{2,}}$') AND regexp_matches(trim(line), '^[A-Z][A-Za-z .''\-]{{1,40}},\s*(the\s+)?(\d{{1,2}}\s+)?[A-Z][a-z]+\s+\d{{1,4}}\.?$')) AS datelines FROM lines GROUP BY doc_id""")
def narrative_signals(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    sep = t.collapse_blanks("line").rlike(r"^([*#•·]\s*){2,}$")
    return lines.groupBy("doc_id").agg(F.count_if(sep).alias("separators"), F.count_if(~sep & t.is_dateline("line")).alias("datelines"))


@query("""SELECT l_orderkey, CASE WHEN y < 0.12 * 50 THEN 'top' WHEN y > 0.88 * 50 THEN 'bottom' ELSE 'body' END AS zone, count(*) AS n, round(avg(y), 4) AS mean_y FROM (SELECT l_orderkey, l_quantity AS y FROM lineitem) GROUP BY l_orderkey, zone""")
def page_zones(spark, sf):
    y = F.col("l_quantity")
    zone = F.when(y < 0.12 * 50, "top").when(y > 0.88 * 50, "bottom").otherwise("body")
    return table(spark, sf, "lineitem").groupBy("l_orderkey", zone.alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_y"))


@query("""SELECT l_orderkey, max(x1) FILTER (x1 <= 25) AS left_edge, min(x0) FILTER (x0 >= 25) AS right_edge, coalesce(max(x1) FILTER (x1 <= 25) <= min(x0) FILTER (x0 >= 25), false) AND NOT bool_or(x0 < 20 AND x1 > 30) AS columns_suspected FROM (SELECT l_orderkey, l_quantity AS x0, l_quantity + l_linenumber AS x1 FROM lineitem) GROUP BY l_orderkey""")
def columns_suspected(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"))
    left, right = F.max(F.when(F.col("x1") <= 25, F.col("x1"))), F.min(F.when(F.col("x0") >= 25, F.col("x0")))
    return li.groupBy("l_orderkey").agg(left.alias("left_edge"), right.alias("right_edge"), (F.coalesce(left <= right, F.lit(False)) & ~F.bool_or((F.col("x0") < 20) & (F.col("x1") > 30))).alias("columns_suspected"))


@query("""SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, round(avg(1 - l_discount) + 1e-9, 6) AS conf, avg(1 - l_discount) + 1e-9 < 0.95 AS suspect, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY l_orderkey""")
def ocr_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    words = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    conf = F.avg(1 - F.col("l_discount"))
    return li.groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.round(conf + 1e-9, 6).alias("conf"), (conf + 1e-9 < 0.95).alias("suspect"), F.array_join(words["l_returnflag"], " ").alias("text"))


@query("""SELECT o_custkey, round(avg(conf) + 1e-9, 6) AS mean_conf, count(*) AS lines, round(count(*) FILTER (conf < 0.94) / count(*), 6) AS suspect_ratio, count(*) FILTER (conf < 0.94) / count(*) > 0.3 AS suspect
FROM (SELECT l_orderkey, avg(1 - l_discount) AS conf FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def ocr_page(spark, sf):
    # a mean on the limit falls by the order in which doubles are added: that of the file, wherever the file is split
    conf = F.when(F.col("l_discount").isNotNull(), F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), (1 - F.col("l_discount")).alias("conf")))
    read = table(spark, sf, "lineitem").select("l_orderkey", conf.alias("w"))
    lines = read.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("w"))["conf"].alias("w"))
    lines = lines.select("l_orderkey", F.when(F.size("w") > 0, F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / F.size("w")).alias("conf"))
    o = table(spark, sf, "orders")
    share = F.count_if(F.col("conf") < 0.94) / F.count("*")
    return lines.join(o, o.o_orderkey == lines.l_orderkey).groupBy("o_custkey").agg(F.round(F.avg("conf") + 1e-9, 6).alias("mean_conf"), F.count("*").alias("lines"), F.round(share, 6).alias("suspect_ratio"), (share > 0.3).alias("suspect"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def ocr_best_attempt(spark, sf):
    rank = F.struct((F.col("l_discount") > 0.05).alias("suspect"), "l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", rank).cast("int").alias("attempt"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 25 >= 1.6 THEN 1 WHEN l_quantity / 25 >= 1.3 THEN 2 WHEN l_quantity / 25 >= 1.15 THEN 3 WHEN l_discount * 10 >= 0.5 OR l_tax * 10 >= 0.8 THEN 4 END AS level,
 CASE WHEN abs((l_quantity + 10) / 2 - 25) <= 2 THEN 'center' WHEN l_quantity < 10 THEN 'left' ELSE 'right' END AS alignment FROM lineitem""")
def heading_levels(spark, sf):
    q = F.col("l_quantity")
    align = F.when(F.abs((q + 10) / 2 - 25) <= 2, "center").when(q < 10, "left").otherwise("right")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.heading_level(q / 25, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("level"), align.alias("alignment"))


@query(f"""WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), k AS (SELECT source, {KEY} AS line_key, count(*) AS n FROM lines GROUP BY source, {KEY}),
h AS (SELECT source, line_key FROM k JOIN p USING (source) WHERE line_key <> '' AND n >= greatest(2, ceil(0.04 * pages)))
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (SELECT *, {KEY} AS line_key FROM lines) l WHERE trim(line) <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.source = l.source AND h.line_key = l.line_key) GROUP BY doc_id""")
def scope_text(spark, sf):
    """Pages without their repeated headers; pages that hold nothing else are dropped."""
    d = table(spark, sf, "documents")
    keyed = ln.lines(d).select("doc_id", "source", "line_no", "line", t.line_key("line").alias("line_key")).where(F.trim("line") != "")
    kept = keyed.join(lo.header_census(d, 0.04).select("source", "line_key"), ["source", "line_key"], "left_anti")
    g = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("doc_id", F.array_join(F.col("l.line"), "\n").alias("text"))


@query(f"""WITH {LINES}, p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), k AS (SELECT source, {KEY} AS line_key, count(*) AS n FROM lines GROUP BY source, {KEY}),
h AS (SELECT source, line_key FROM k JOIN p USING (source) WHERE line_key <> '' AND n >= greatest(2, ceil(0.04 * pages)))
SELECT doc_id, bool_and(h.line_key IS NOT NULL) AS excluded FROM (SELECT doc_id, source, {KEY} AS line_key FROM lines) l LEFT JOIN h USING (source, line_key) WHERE line_key <> '' GROUP BY doc_id""")
def page_exclusions(spark, sf):
    """Pages all of whose lines are repeated headers."""
    d = table(spark, sf, "documents")
    keyed = ln.lines(d).select("doc_id", "source", t.line_key("line").alias("line_key")).where("line_key <> ''")
    h = lo.header_census(d, 0.04).select("source", "line_key", F.lit(True).alias("header"))
    return keyed.join(h, ["source", "line_key"], "left").groupBy("doc_id").agg(F.bool_and(F.col("header").isNotNull()).alias("excluded"))
