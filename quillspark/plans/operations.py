"""Queries over preparation, answers of models, jobs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import preprocess as pp
from ..functions import text as t
from ..operators import lines as ln
from ..operators import ranking as rk
from ..operators import structure as st
from ..operators.durable import new_path
from ..session import table
from ..streaming import progress as sp
from .memory import TERMS_SQL, pairs, terms
from .texts import LINES


@query("SELECT doc_id, true AS restored FROM documents")
def restore_roundtrip(spark, sf):
    """Every text comes back from its prepared form."""
    d = table(spark, sf, "documents").select("doc_id", "text", pp.prepare("text").alias("p"))
    return d.select("doc_id", (pp.restore("p") == F.col("text")).alias("restored"))


@query("SELECT conv_id, turn, text = target AS same FROM (SELECT conv_id, turn, text, target FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL)")
def word_diff(spark, sf):
    """A diff without changes is one of equal texts."""
    p = pairs(spark, sf).select("conv_id", "turn", pp.word_diff("source", "target").alias("d"))
    return p.select("conv_id", "turn", F.forall("d", lambda x: x["op"] == "equal").alias("same"))


@query()
def cer_wer(spark, sf):
    """Word error rate of each line against its dehyphenated form, and character error rate against lower case."""
    x = ln.lines(table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))
    return x.select("doc_id", "line_no", F.round(pp.wer("line", pp.dehyphenate("line")), 6).alias("wer"), F.round(pp.cer("line", F.lower("line")), 6).alias("cer"))


@query("SELECT event_id, props AS answer, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, sf):
    """Answers in fences, with raw line feeds, parsed."""
    e = table(spark, sf, "events").select("event_id", "props", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("raw"))
    j = e.select("event_id", "props", pp.tolerant_json("raw").alias("j"))
    return j.select("event_id", F.when(F.col("j").isNotNull(), F.col("props")).alias("answer"), F.get_json_object("j", "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, value / 100.0)), 4) AS p FROM events")
def qe_probabilities(spark, sf):
    """A number out of an answer around it, held to 0 to 1."""
    raw = F.concat(F.lit('Sure: {"p": '), F.col("value") / 100.0, F.lit("} done"))
    found = F.get_json_object(F.regexp_extract(raw, r"(\{.*\})", 1), "$.p").try_cast("double")
    return table(spark, sf, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.0)))), 4).alias("p"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS jobs, round(sum(value), 3) AS seconds FROM events GROUP BY 1, 2")
def stream_progress(spark, sf):
    """The stream's table once all events are in: closed windows, and the last ones closed by hand."""
    events = sp.read_events(spark, sf)
    path = new_path(spark, "stream")
    rows = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("jobs"), F.sum("value").alias("seconds"))

    def keep(df, epoch):
        df.select(F.col("w.start").alias("start"), "event_type", "jobs", F.round("seconds", 3).alias("seconds")).write.mode("overwrite").parquet(f"{path}/table")

    rows.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def rate_limit(spark, sf):
    """Which events a token bucket of each user lets through."""
    path = new_path(spark, "limits")
    sp.run_available(sp.limited(sp.read_events(spark, sf), 1 / 3600, 5.0), f"{path}/table", f"{path}/log")
    return spark.read.schema("user_id long, event_id long, allowed boolean").parquet(f"{path}/table")


@query(f"""WITH {TERMS_SQL}, h AS (SELECT doc_id, source_term, len(regexp_extract_all(lower(text), replace(lower(source_term), '-', '\\-') || '[^\\s]+')) AS forms FROM documents, terms WHERE source_term <> '')
SELECT doc_id, source_term, forms FROM h WHERE forms > 0""")
def style_conflicts(spark, sf):
    """Forms in a text that go on after a term."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    x = d.join(F.broadcast(terms(spark).where("source_term <> ''").select("source_term")), F.lit(True))
    pattern = F.concat(F.replace(F.lower("source_term"), F.lit("-"), F.lit("\\-")), F.lit(r"[^\s]+"))
    return x.select("doc_id", "source_term", F.regexp_count("low", pattern).cast("long").alias("forms")).where("forms > 0")


@query(r"""WITH c AS (SELECT p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS n, sha256(p_name || ':' || CAST(p_partkey AS VARCHAR)) AS id FROM part)
SELECT p_type, (n - 1) // 12 AS block, count(*) AS candidates, sha256(string_agg(id, chr(10) ORDER BY n)) AS block_hash FROM c GROUP BY p_type, (n - 1) // 12""")
def candidate_blocks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", F.sha2(F.concat_ws(":", "p_name", "p_partkey"), 256).alias("id"))
    n = rk.numbered(p, ["p_type"], [F.col("p_name"), F.col("p_partkey")])
    g = n.groupBy("p_type", F.floor((F.col("n") - 1) / 12).alias("block")).agg(F.count("*").alias("candidates"), F.sort_array(F.collect_list(F.struct("n", "id"))).alias("l"))
    return g.select("p_type", "block", "candidates", F.sha2(F.array_join(F.col("l.id"), "\n"), 256).alias("block_hash"))


@query(f"""WITH {LINES}, s AS (SELECT lang, len(line) AS size, sum(len(line)) AS chars FROM lines WHERE line <> '' GROUP BY lang, len(line)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY chars DESC, size) AS k FROM s)
SELECT lang, CAST(size AS BIGINT) AS size, CAST(chars AS BIGINT) AS chars FROM r WHERE k <= 6""")
def typography(spark, sf):
    """The six commonest line lengths of a language, by characters."""
    x = ln.lines(table(spark, sf, "documents")).where("line <> ''").groupBy("lang", F.length("line").cast("long").alias("size")).agg(F.sum(F.length("line").cast("long")).alias("chars"))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("chars"), "size"))).where("k <= 6").drop("k")


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, list_filter(string_split(regexp_replace(lower(line), '[ \\t]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM lines),
b AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, array_to_string(w[1:6], ' ') AS lead FROM b WHERE len(w) >= 6),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i+5], ' '))) AS lead FROM w)
SELECT item_id, doc_id FROM k JOIN g USING (lead)""")
def segment_pages(spark, sf):
    """Which documents hold the first six words of a segment in one line: an equi-join on word runs."""
    low = lambda c: t.words(F.lower(c))
    b = table(spark, sf, "benchmark").select("item_id", low("text").alias("w")).where("size(w) >= 6").select("item_id", F.array_join(F.slice("w", 1, 6), " ").alias("lead")).distinct()
    x = ln.lines(table(spark, sf, "documents")).select("doc_id", low("line").alias("w")).where("size(w) >= 6")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))
    return x.select("doc_id", F.explode(runs).alias("lead")).join(b, "lead").select("item_id", "doc_id").distinct()


@query()
def segment_page_windows(spark, sf):
    """Which documents hold the first 12, 8, 6 or 4 words of a segment, across lines, and how many of them."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    return st.page_windows(table(spark, sf, "benchmark"), pages).select("item_id", F.col("page").alias("doc_id"), "window")


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS start_page, c_custkey + CAST(c_nationkey AS BIGINT) * 5 AS end_page FROM customer)
SELECT k, start_page, CAST(max(end_page) OVER (PARTITION BY k ORDER BY start_page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS reach FROM r""")
def range_repair(spark, sf):
    """How far ranges reach up to each, so that a later one may begin after it: a running maximum."""
    r = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("start_page"), (F.col("c_custkey") + F.col("c_nationkey") * 5).cast("bigint").alias("end_page"))
    w = Window.partitionBy("k").orderBy("start_page").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("k", "start_page", F.max("end_page").over(w).alias("reach"))
