"""Queries over packing, context and re-segmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as t
from ..operators import lines as ln
from ..operators import packing as pk
from ..session import table
from .texts import LINES, SENTENCES, TOKENS


def _packing_sql(rows: str, limit: int, more: str = "") -> str:
    """Recursive SQL of greedy packing over rows(k, n, w), n from 1 without gaps."""
    full = f"p.total + r.w > {limit}{more}"
    return f"""rows AS ({rows}), p(k, n, w, block, total, cnt) AS (
  SELECT k, n, w, 0, w, 1 FROM rows WHERE n = 1
  UNION ALL SELECT r.k, r.n, r.w, p.block + CASE WHEN {full} THEN 1 ELSE 0 END, CASE WHEN {full} THEN r.w ELSE p.total + r.w END, CASE WHEN {full} THEN 1 ELSE p.cnt + 1 END FROM p JOIN rows r ON r.k = p.k AND r.n = p.n + 1)"""


SENTENCE_ROWS = f"SELECT doc_id AS k, n, {TOKENS.format(x='s')} AS w FROM sents"


def _sentence_packs(spark, sf, limit, max_rows=None):
    s = ln.sentences(table(spark, sf, "documents"))
    return pk.packed(s, ["doc_id"], "ordinal", t.estimated_tokens("sentence"), limit, max_rows)


@query(f"""WITH RECURSIVE {SENTENCES}, {_packing_sql(SENTENCE_ROWS, 400)}
SELECT k AS doc_id, CAST(block AS BIGINT) AS block, count(*) AS segments, CAST(sum(w) AS BIGINT) AS source, CAST(sum(w) AS BIGINT) + 18884 AS total, sum(w) > 400 AS oversized FROM p GROUP BY k, block""")
def block_pack(spark, sf):
    b = pk.blocks(_sentence_packs(spark, sf, 400), ["doc_id"], "ordinal", 400)
    return b.select("doc_id", "block", "segments", "source", "total", "oversized")


@query(f"""WITH RECURSIVE {SENTENCES}, {_packing_sql(SENTENCE_ROWS, 400)}, b AS (SELECT k, block, min(n) AS a, max(n) AS z FROM p GROUP BY k, block), m AS (SELECT k, max(n) AS m FROM p GROUP BY k)
SELECT k AS doc_id, CAST(block AS BIGINT) AS block, CASE WHEN a = 1 THEN '' WHEN a = 2 THEN '1' ELSE CAST(a - 2 AS VARCHAR) || ',' || CAST(a - 1 AS VARCHAR) END AS preceding, CASE WHEN z < m THEN z + 1 END AS following FROM b JOIN m USING (k)""")
def block_overlap(spark, sf):
    b = pk.blocks(_sentence_packs(spark, sf, 400), ["doc_id"], "ordinal", 400)
    return b.select("doc_id", "block", F.array_join("preceding", ",").alias("preceding"), "following")


@query(f"""WITH RECURSIVE {SENTENCES}, {_packing_sql(SENTENCE_ROWS, 300, " OR p.cnt >= 20")} SELECT k AS doc_id, CAST(block AS BIGINT) AS block, count(*) AS segments, CAST(sum(w) AS BIGINT) AS tokens FROM p GROUP BY k, block""")
def resume_pack(spark, sf):
    return _sentence_packs(spark, sf, 300, 20).groupBy("doc_id", "block").agg(F.count("*").alias("segments"), F.sum("weight").alias("tokens"))


@query(f"""WITH RECURSIVE {LINES}, rows AS (SELECT doc_id AS k, line_no AS n, CAST(len(line) AS BIGINT) AS w FROM lines), p(k, n, w, block, total) AS (
  SELECT k, n, w, 0, w FROM rows WHERE n = 1
  UNION ALL SELECT r.k, r.n, r.w, p.block + CASE WHEN p.total >= 1800 THEN 1 ELSE 0 END, CASE WHEN p.total >= 1800 THEN r.w ELSE p.total + r.w END FROM p JOIN rows r ON r.k = p.k AND r.n = p.n + 1)
SELECT k AS doc_id, CAST(block AS BIGINT) AS page, count(*) AS lines, CAST(sum(w) AS BIGINT) AS chars FROM p GROUP BY k, block""")
def book_pages(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    p = pk.packed(lines, ["doc_id"], "line_no", F.length("line"), 1800, before=False, name="page")
    return p.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum("weight").alias("chars"))


@query("""SELECT conv_id, turn, array_to_string(list(turn) OVER w, ',') AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def context_pm2(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(F.col("turn").cast("string")).over(w), ",").alias("context"))


@query(f"""WITH {LINES}, q AS (SELECT doc_id, list(line ORDER BY line_no) AS l FROM lines GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(array_to_string(list_transform(l, lambda x: trim(x)), ' '), '\\S{{3,}}-\\s+\\S+')) AS ambiguous FROM q""")
def ambiguous_hyphens(spark, sf):
    joined = F.array_join(F.transform(F.split("text", "\n"), F.trim), " ")
    return table(spark, sf, "documents").select("doc_id", F.regexp_count(joined, F.lit(r"\S{3,}-\s+\S+")).cast("long").alias("ambiguous"))


@query(f"""WITH {LINES}, old AS (SELECT doc_id, line_no AS ordinal, line, line_no % 3 = 0 AS approved FROM lines), new AS (SELECT doc_id, line_no AS ordinal, lower(line) AS line FROM lines WHERE line_no % 5 <> 0)
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CAST(coalesce(n.ordinal, o.ordinal) AS BIGINT) AS ordinal, CASE WHEN o.approved THEN 'kept' WHEN n.doc_id IS NULL THEN 'dropped' WHEN o.doc_id IS NULL THEN 'added' WHEN n.line = o.line THEN 'same' ELSE 'changed' END AS outcome
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id AND o.ordinal = n.ordinal""")
def resegment_upsert(spark, sf):
    lines = ln.lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").alias("ordinal"), "line")
    old = lines.withColumn("approved", F.col("ordinal") % 3 == 0)
    new = lines.where("ordinal % 5 <> 0").select("doc_id", "ordinal", F.lower("line").alias("fresh"))
    j = old.join(new, ["doc_id", "ordinal"], "full")
    outcome = F.when(F.col("approved"), "kept").when(F.col("fresh").isNull(), "dropped").when(F.col("line").isNull(), "added").when(F.col("line") == F.col("fresh"), "same").otherwise("changed")
    return j.select("doc_id", "ordinal", outcome.alias("outcome"))


@query("""SELECT doc_id, CAST(greatest(1, round(n_chars / 3400.0)) AS BIGINT) AS pages, n_chars <= 16384 AS within, 35264 - n_chars AS remaining, CASE WHEN n_chars + 18884 <= 35264 THEN 'ok' ELSE 'insufficient' END AS status FROM documents""")
def budget_status(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.greatest(F.lit(1), F.round(n / 3400)).cast("long").alias("pages"), (n <= pk.SOURCE_BUDGET).alias("within"), (35264 - n).alias("remaining"), F.when(n + pk.CONTEXT_RESERVE + pk.OUTPUT_RESERVE <= 35264, "ok").otherwise("insufficient").alias("status"))


@query(f"""WITH RECURSIVE {SENTENCES}, {_packing_sql(SENTENCE_ROWS, 400)}, b AS (SELECT k, block, sum(w) AS w FROM p GROUP BY k, block) SELECT CAST(max(w) AS BIGINT) + 18884 AS max_total, bool_and(w <= 400) AS within, count(*) FILTER (w > 400) AS oversized FROM b""")
def verify_blocks(spark, sf):
    b = pk.blocks(_sentence_packs(spark, sf, 400), ["doc_id"], "ordinal", 400)
    return b.agg(F.max("total").alias("max_total"), F.bool_and(~F.col("oversized")).alias("within"), F.count_if("oversized").alias("oversized"))


@query(f"""WITH RECURSIVE {SENTENCES}, {_packing_sql(SENTENCE_ROWS, 400)} SELECT p.k AS doc_id, CAST(block AS BIGINT) AS block, '{{"segments":[' || string_agg('{{"ordinal":' || p.n || ',"sha256":"' || sha256(s) || '"}}', ',' ORDER BY p.n) || ']}}' AS payload FROM p JOIN sents ON sents.doc_id = p.k AND sents.n = p.n GROUP BY p.k, block""")
def block_payload(spark, sf):
    """A block as JSON: its segments in order, by digest."""
    s = ln.sentences(table(spark, sf, "documents")).select("doc_id", "ordinal", F.sha2("sentence", 256).alias("sha256"))
    p = _sentence_packs(spark, sf, 400).join(s, ["doc_id", "ordinal"])
    g = p.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(F.struct("ordinal", "sha256"))).alias("segments"))
    return g.select("doc_id", "block", F.to_json(F.struct("segments")).alias("payload"))
