"""Queries over structure, reports and the editing of segments and entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import preprocess as pp
from ..functions import text as t
from ..operators import layout as lo
from ..operators import lines as ln
from ..operators import structure as st
from ..session import table
from .exchange import UNITS, units
from .layout import NODES, PAGED
from .memory import TERMS_SQL, terms
from .texts import LINES, TOKENS


@query()
def structure_nodes(spark, sf):
    """Chapters of the stand-in books from the words and looks of their lines."""
    return st.nodes(lo.pages(table(spark, sf, "documents")), 0.2)


@query()
def structure_parts(spark, sf):
    return st.parts(st.nodes(lo.pages(table(spark, sf, "documents")), 0.2), 1)


@query(rf"""WITH {PAGED}, l AS (SELECT source, page_number, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g'))) AS line FROM paged),
e AS (SELECT source, page_number AS page, CASE WHEN page_number % 2 = 0 THEN string_split(text, chr(10))[1] ELSE 'no such line' END AS title FROM paged)
SELECT e.source, title, page, coalesce(bool_or(line = lower(trim(regexp_replace(title, '[ \t]+', ' ', 'g')))), false) AS verified FROM e LEFT JOIN l ON e.source = l.source AND e.page = l.page_number GROUP BY e.source, title, page""")
def toc_verify(spark, sf):
    p = lo.pages(table(spark, sf, "documents"))
    e = p.select("source", F.col("page_number").alias("page"), F.when(F.col("page_number") % 2 == 0, F.element_at(F.split("text", "\n"), 1)).otherwise("no such line").alias("title"))
    return st.verified_toc(e, p)


@query(f"""WITH {LINES}, s AS (SELECT source, doc_id, count(*) AS segments, CAST(sum({TOKENS.format(x='line')}) AS BIGINT) AS tokens, CAST(sum(len(line)) AS BIGINT) AS chars, max({TOKENS.format(x='line')}) > 400 AS over_limit FROM lines GROUP BY source, doc_id)
SELECT source, count(*) AS chapters, CAST(sum(segments) AS BIGINT) AS segments, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(chars) AS BIGINT) AS chars, bool_or(over_limit) AS over_limit FROM s GROUP BY source""")
def segments_overview(spark, sf):
    x = ln.lines(table(spark, sf, "documents")).select("source", "doc_id", t.estimated_tokens("line").alias("tokens"), F.length("line").cast("long").alias("chars"))
    return x.groupBy("source").agg(F.countDistinct("doc_id").alias("chapters"), F.count("*").alias("segments"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.bool_or(F.col("tokens") > 400).alias("over_limit"))


@query("""SELECT count(*) AS pages, count(*) FILTER (n_chars > 0) AS pages_ok, count(*) FILTER (n_chars < 400) AS ocr_needed, round(count(*) FILTER (n_chars < 400) / greatest(1, count(*)), 4) AS share, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents""")
def import_report(spark, sf):
    d = table(spark, sf, "documents")
    few = F.count_if(F.col("n_chars") < 400)
    return d.agg(F.count("*").alias("pages"), F.count_if(F.col("n_chars") > 0).alias("pages_ok"), few.alias("ocr_needed"), F.round(few / F.greatest(F.lit(1), F.count("*")), 4).alias("share"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT p_brand, p_size AS body FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY p_brand, p_size) WHERE r = 1")
def body_font(spark, sf):
    """The commonest size; the smallest of equally common ones."""
    n = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return n.groupBy("p_brand").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("body"))


@query("SELECT user_id, count(*) AS mentions, min(ts) AS first_seen, arg_min(event_type, event_id) AS first_evidence, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS aliases FROM events GROUP BY user_id")
def entity_summary(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("mentions"), F.min("ts").alias("first_seen"), F.min_by("event_type", "event_id").alias("first_evidence"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("aliases"))


@query("SELECT user_id AS coref, arg_min(event_type, event_id) AS canonical, count(DISTINCT event_type) - 1 AS aliases, count(*) AS mentions FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'view') > 0")
def mention_clusters(spark, sf):
    """The first mention names a cluster, the others are aliases; clusters of one kind alone are dropped."""
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("coref")).agg(F.min_by("event_type", "event_id").alias("canonical"), (F.countDistinct("event_type") - 1).alias("aliases"), F.count("*").alias("mentions"), F.count_if(F.col("event_type") != "view").alias("others"))
    return g.where("others > 0").drop("others")


@query("SELECT event_type AS model, count(*) AS runs, count(*) FILTER (value > 50) AS compliant, round(count(*) FILTER (value > 50) / nullif(count(*), 0), 6) AS rate FROM events GROUP BY event_type")
def run_counters(spark, sf):
    ok = F.count_if(F.col("value") > 50)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("runs"), ok.alias("compliant"), F.round(ok / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS joined, max(line_no) = count(*) AS sequential FROM lines GROUP BY doc_id)
SELECT doc_id, trim(regexp_replace(joined, '[ \t\n\r]+', ' ', 'g')) = trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS same, sequential FROM s JOIN documents USING (doc_id)""")
def segment_verify(spark, sf):
    """Do a text's segments in order give the text, white space aside, and do their ordinals run from 1?"""
    d = table(spark, sf, "documents")
    s = ln.lines(d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    j = s.join(d.select("doc_id", "text"), "doc_id")
    return j.select("doc_id", (t.collapse(F.array_join(F.col("l.line"), " ")) == t.collapse("text")).alias("same"), (F.col("l.line_no") == F.sequence(F.lit(1).cast("long"), F.size("l").cast("long"))).alias("sequential"))


@query("SELECT round(avg(CASE WHEN (toxic = 1) = contains(text, 'idiot') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def gold_precision(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    right = (F.col("toxic") == 1) == F.col("text").contains("idiot")
    return j.agg(F.round(F.avg(right.cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderpriority = '2-HIGH') AS major, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS minor FROM orders GROUP BY o_custkey")
def critic_counts(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(p == "1-URGENT").alias("critical"), F.count_if(p == "2-HIGH").alias("major"), F.count_if(~p.isin("1-URGENT", "2-HIGH")).alias("minor"))


@query(rf"""WITH {PAGED}, x AS (SELECT source, page_number, text, lag(text) OVER (PARTITION BY source ORDER BY page_number) AS prev FROM paged)
SELECT source, page_number, prev IS NOT NULL AND NOT regexp_matches(rtrim(prev, ' ' || chr(10)), '[.!?…]["''”’»)\]}}*]*$') AND NOT regexp_matches(text, '^\p{{Lu}}') AS continues FROM x""")
def page_continuation(spark, sf):
    """Does a page go on with the paragraph of the one before: no sentence end there, no capital here?"""
    p = lo.pages(table(spark, sf, "documents"))
    prev = F.lag("text").over(Window.partitionBy("source").orderBy("page_number"))
    x = p.select("source", "page_number", "text", prev.alias("prev"))
    return x.select("source", "page_number", (F.col("prev").isNotNull() & ~F.coalesce(t.ends_terminal("prev"), F.lit(True)) & ~F.col("text").rlike(r"^\p{Lu}")).alias("continues"))


@query(rf"""WITH s AS (SELECT conv_id, turn, text, (len(regexp_extract_all(text, '[(\[{{«]')) > len(regexp_extract_all(text, '[)\]}}»]')) OR len(regexp_extract_all(text, '"')) % 2 = 1 OR regexp_matches(rtrim(text, ' ' || chr(10)), '[,:;—–]$')) AS open FROM conversations),
f AS (SELECT *, CASE WHEN coalesce(lag(open) OVER (PARTITION BY conv_id ORDER BY turn), false) THEN 0 ELSE 1 END AS fresh FROM s)
SELECT conv_id, CAST(island AS BIGINT) AS island, count(*) AS parts FROM (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f) GROUP BY conv_id, island""")
def protected_boundaries(spark, sf):
    """Sentences whose end must not stand (open bracket or quotation, connective) join the next."""
    open_ = (t.bracket_balance("text") > 0) | (F.regexp_count("text", F.lit('"')) % 2 == 1) | t.ends_soft("text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(open_, F.lit(False)).alias("open"))
    c = c.withColumn("fresh", ~F.coalesce(F.lag("open").over(w), F.lit(False)))
    c = c.withColumn("island", F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(w))
    return c.groupBy("conv_id", "island").agg(F.count("*").alias("parts"))


@query(f"WITH {UNITS} SELECT chapter, bool_and(status <> 'approved') AS may_clear, count(*) FILTER (status = 'approved') AS approved FROM units GROUP BY chapter")
def clear_guard(spark, sf):
    ok = F.col("status") == "approved"
    return units(spark, sf).groupBy("chapter").agg(F.bool_and(~ok).alias("may_clear"), F.count_if(ok).alias("approved"))


@query(f"WITH {UNITS}, a AS (SELECT chapter, sha256(string_agg(source, chr(10) ORDER BY ordinal)) AS h FROM units GROUP BY chapter), b AS (SELECT chapter, sha256(string_agg(CASE WHEN CAST(chapter AS INT) % 3 = 0 THEN lower(source) ELSE source END, chr(10) ORDER BY ordinal)) AS h FROM units GROUP BY chapter) SELECT a.chapter FROM a JOIN b USING (chapter) WHERE a.h <> b.h")
def touched_chapters(spark, sf):
    """Chapters whose text an edit changed: those alone are segmented again."""

    def hashed(df):
        return df.groupBy("chapter").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", "source")))["source"], "\n"), 256).alias("h"))

    u = units(spark, sf)
    edited = u.withColumn("source", F.when(F.col("chapter").cast("int") % 3 == 0, F.lower("source")).otherwise(F.col("source")))
    return hashed(u).join(hashed(edited).withColumnRenamed("h", "new"), "chapter").where("h <> new").select("chapter")


@query(f"WITH {UNITS} SELECT count(*) AS segments, count(DISTINCT chapter) AS chapters, CAST(sum(CAST('0x' || sha256(segment_id)[1:8] AS BIGINT)) AS BIGINT) AS snapshot, count(*) FILTER (status = 'approved') AS approved FROM units")
def export_manifest(spark, sf):
    """One row of counts, and a checksum of the ids that needs no order: every task sums its own."""
    u = units(spark, sf)
    part = F.conv(F.substring(F.sha2("segment_id", 256), 1, 8), 16, 10).cast("bigint")
    return u.agg(F.count("*").alias("segments"), F.countDistinct("chapter").alias("chapters"), F.sum(part).alias("snapshot"), F.count_if(F.col("status") == "approved").alias("approved"))


@query(f"WITH {TERMS_SQL} SELECT count(*) AS terms, array_to_string(list_sort(list(DISTINCT target_term) FILTER (status = 'approved')), '|') AS keep FROM terms")
def term_snapshot(spark, sf):
    return terms(spark).agg(F.count("*").alias("terms"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "approved", F.col("target_term")))), "|").alias("keep"))


@query(f"""WITH {UNITS}, have AS (SELECT segment_id FROM units WHERE ordinal % 8 = 0), a AS (SELECT segment_id, source, target FROM units WHERE status = 'approved')
SELECT segment_id, source, target FROM a WHERE segment_id NOT IN (SELECT segment_id FROM have)""")
def approve_hook(spark, sf):
    """Approved segments that the memory lacks: what an approval adds, once."""
    u = units(spark, sf)
    return u.where("status = 'approved'").join(u.where("ordinal % 8 = 0").select("segment_id"), "segment_id", "left_anti").select("segment_id", "source", "target")


@query("""WITH s AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT d.doc_id, s.doc_id IS NOT NULL AS ocr_suspect FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM s) s USING (doc_id)""")
def suspect_flags(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    return table(spark, sf, "documents").join(bad, "doc_id", "left").select("doc_id", F.col("bad").isNotNull().alias("ocr_suspect"))


@query(f"WITH {UNITS} SELECT chapter, bool_or(ordinal % 6 = 5 OR status = 'untranslated') AS suspect FROM units GROUP BY chapter")
def evidence_flags(spark, sf):
    return units(spark, sf).groupBy("chapter").agg(F.bool_or((F.col("ordinal") % 6 == 5) | (F.col("status") == "untranslated")).alias("suspect"))


@query("""SELECT doc_id, text LIKE '{%' AS looks_json, coalesce(try_cast(json_valid(text) AS BOOLEAN), false) AS valid FROM documents""")
def val_syntax(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").startswith("{").alias("looks_json"), pp.is_json(F.col("text")).alias("valid"))


@query("""SELECT p_partkey, CAST(round(least(100.0, p_size * 2.0), 4) AS DOUBLE) AS width_pct, p_retailprice > 0 AND p_size > 1 AS visible, round(p_size * 25.4 / 72, 4) AS mm FROM part""")
def image_layout(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(F.least(F.lit(100.0), F.col("p_size") * 2.0), 4).alias("width_pct"), ((F.col("p_retailprice") > 0) & (F.col("p_size") > 1)).alias("visible"), F.round(F.col("p_size") * 25.4 / 72, 4).alias("mm"))


@query("""SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS batch FROM customer""")
def name_batches(spark, sf):
    from ..operators import ranking as rk

    n = rk.numbered(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], [F.col("c_custkey")])
    return n.select("c_custkey", F.floor((F.col("n") - 1) / 20).alias("batch"))


@query(f"WITH {PAGED}, {NODES} SELECT source, count(*) AS chapters, round(avg(end_page - start_page + 1), 4) AS mean_pages, max(end_page) AS last FROM ranges GROUP BY source")
def chapter_preview(spark, sf):
    from .layout import _ranges

    r = _ranges(lo.pages(table(spark, sf, "documents")))
    return r.groupBy("source").agg(F.count("*").alias("chapters"), F.round(F.avg(F.col("end_page") - F.col("start_page") + 1), 4).alias("mean_pages"), F.max("end_page").alias("last"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, l_discount) AS score FROM lineitem WHERE l_returnflag = 'N'")
def keep_old_scores(spark, sf):
    """New scores where there are any, the old ones else."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_tax") > 0.04, F.col("l_tax")), F.col("l_discount")).alias("score"))
