"""Queries over interchange files and re-import."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import reimport as ri
from ..operators.durable import new_path
from ..session import table
from ..sources import interchange as ix
from .memory import PAIRS, TERMS_SQL, pairs, terms

UNITS = f"""{PAIRS}, units AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS segment_id, CAST(conv_id AS VARCHAR) AS chapter, CAST(turn AS BIGINT) AS ordinal,
 CASE turn % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'machine_draft' WHEN 2 THEN 'in_review' ELSE 'untranslated' END AS status, 'paragraph' AS kind, source, target FROM bi)"""


def units(spark, sf):
    p = pairs(spark, sf)
    n = F.col("turn") % 4
    status = F.when(n == 0, "approved").when(n == 1, "machine_draft").when(n == 2, "in_review").otherwise("untranslated")
    return p.select(F.concat_ws(":", "conv_id", "turn").alias("segment_id"), F.col("conv_id").cast("string").alias("chapter"), F.col("turn").cast("bigint").alias("ordinal"), status.alias("status"), F.lit("paragraph").alias("kind"), "source", "target")


@query(f"WITH {UNITS} SELECT * FROM units")
def csv_roundtrip(spark, sf):
    path = new_path(spark, "csv")
    ix.write_csv(units(spark, sf), path)
    return ix.read_csv(spark, path)


@query(f"WITH {UNITS} SELECT segment_id, source, target FROM units WHERE target <> ''")
def tmx_roundtrip(spark, sf):
    path = new_path(spark, "tmx")
    ix.write_tmx(units(spark, sf), path, "en", "it")
    return ix.read_tmx(spark, path)


@query(f"WITH {UNITS} SELECT segment_id, status, source, target FROM units")
def xliff_roundtrip(spark, sf):
    path = new_path(spark, "xliff")
    ix.write_xliff(units(spark, sf), path, "en", "it")
    return ix.read_xliff(spark, path)


@query(f"WITH {TERMS_SQL} SELECT source_term, target_term, term_type, status FROM terms WHERE source_term <> ''")
def tbx_roundtrip(spark, sf):
    path = new_path(spark, "tbx")
    ix.write_tbx(terms(spark).where("source_term <> ''"), path, "it")
    return ix.read_tbx(spark, path)


@query(f"WITH {UNITS} SELECT status, CASE status WHEN 'untranslated' THEN 'initial' WHEN 'machine_draft' THEN 'translated' WHEN 'in_review' THEN 'reviewed' ELSE 'final' END AS state, count(*) AS n FROM units GROUP BY status")
def xliff_state(spark, sf):
    return units(spark, sf).groupBy("status").agg(F.count("*").alias("n")).select("status", ix.state_of("status").alias("state"), "n")


@query(f"""WITH {UNITS}, i AS (SELECT CASE WHEN ordinal % 7 = 6 THEN 'x' || segment_id ELSE segment_id END AS segment_id, CASE ordinal % 5 WHEN 0 THEN '' WHEN 1 THEN upper(target) ELSE target END AS target, CASE ordinal % 3 WHEN 0 THEN 'approved' ELSE 'in_review' END AS status FROM units)
SELECT i.segment_id, CASE WHEN u.segment_id IS NULL THEN 'not_found' WHEN coalesce(i.target, '') = '' THEN 'skipped' WHEN u.status = 'approved' AND coalesce(u.target, '') <> i.target THEN 'conflict' WHEN i.status = 'approved' AND u.status <> 'approved' THEN 'approved' WHEN coalesce(u.target, '') = i.target THEN 'unchanged' ELSE 'updated' END AS outcome
FROM i LEFT JOIN units u ON i.segment_id = u.segment_id""")
def reimport_outcome(spark, sf):
    u = units(spark, sf)
    n = F.col("ordinal")
    i = u.select(F.when(n % 7 == 6, F.concat(F.lit("x"), "segment_id")).otherwise(F.col("segment_id")).alias("segment_id"), F.when(n % 5 == 0, "").when(n % 5 == 1, F.upper("target")).otherwise(F.col("target")).alias("target"), F.when(n % 3 == 0, "approved").otherwise("in_review").alias("status"))
    return ri.outcomes(i, u)


@query(f"""WITH {UNITS} SELECT chapter, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status <> 'approved') AS drafts, count(*) FILTER (target <> '') AS with_target, bool_and(status = 'approved') AS final FROM units GROUP BY chapter""")
def export_plan(spark, sf):
    ok = F.col("status") == "approved"
    return units(spark, sf).groupBy("chapter").agg(F.count("*").alias("total"), F.count_if(ok).alias("approved"), F.count_if(~ok).alias("drafts"), F.count_if(F.col("target") != "").alias("with_target"), F.bool_and(ok).alias("final"))


@query(f"""WITH {UNITS} SELECT segment_id, '<p class="body' || CASE WHEN coalesce(target, '') = '' THEN ' draft' ELSE '' END || '">' || replace(replace(replace(replace(replace(CASE WHEN coalesce(target, '') = '' THEN source ELSE target END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '&#10;') || '</p>' AS html FROM units""")
def html_book(spark, sf):
    return ix.html_paragraphs(units(spark, sf))


@query(f"""WITH {UNITS} SELECT segment_id, CASE WHEN status <> 'approved' AND ordinal % 2 = 1 THEN lower(target) ELSE target END AS target, CASE WHEN status <> 'approved' AND ordinal % 2 = 1 AND lower(target) <> target THEN 'machine_draft' ELSE status END AS status, CASE WHEN status <> 'approved' AND ordinal % 2 = 1 AND lower(target) <> target THEN NULL ELSE ordinal END AS score FROM units""")
def draft_save(spark, sf):
    u = units(spark, sf)
    drafts = u.where("ordinal % 2 = 1").select("segment_id", F.lower("target").alias("draft"))
    return ri.saved_drafts(u.select("segment_id", "target", "status", F.col("ordinal").alias("score")), drafts)


@query(f"WITH {UNITS} SELECT segment_id, true AS is_before, source AS text FROM units UNION ALL SELECT segment_id, false, target FROM units")
def version_freeze(spark, sf):
    return ri.versions(units(spark, sf).select("segment_id", F.col("source").alias("before"), F.col("target").alias("after")))


@query("""SELECT o_custkey AS segment_id, min(o_orderkey) AS attempt, arg_min(o_orderpriority, o_orderkey) AS response FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def attempt_ladder(spark, sf):
    o = table(spark, sf, "orders")
    return ri.first_clean(o.select(F.col("o_custkey").alias("segment_id"), F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("response"), (F.col("o_orderstatus") == "F").alias("hard")))


@query("SELECT conv_id AS segment_id, arg_max(text, len(text) * 100000 - turn) AS target FROM conversations GROUP BY conv_id")
def dedupe_longest(spark, sf):
    return ri.longest(table(spark, sf, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("seq"), F.col("text").alias("target")))


@query(f"""WITH {UNITS} SELECT CAST(chapter AS BIGINT) AS chapter, string_agg('[' || segment_id || '] ' || source, chr(10) ORDER BY ordinal) AS batch, sha256(string_agg('[' || segment_id || '] ' || source, chr(10) ORDER BY ordinal))[1:16] AS run_ref FROM units GROUP BY chapter""")
def prompt_batches(spark, sf):
    g = units(spark, sf).groupBy(F.col("chapter").cast("bigint").alias("chapter")).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.concat(F.lit("["), "segment_id", F.lit("] "), "source").alias("t")))).alias("l"))
    batch = F.array_join(F.col("l.t"), "\n")
    return g.select("chapter", batch.alias("batch"), F.substring(F.sha2(batch, 256), 1, 16).alias("run_ref"))
