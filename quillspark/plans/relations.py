"""Queries over relational shapes: filters, joins, aggregations, windows, sorting, sets.

Stand-ins: customers are segments (nation: chapter, account balance: score), orders are
their issues (priority: severity, status: resolved or not), events are jobs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import ranking as rk
from ..session import table


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F')")
def issue_semi(spark, sf):
    open_ = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
    c = table(spark, sf, "customer")
    return c.join(open_, c.c_custkey == open_.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("""WITH i AS (SELECT o_custkey, count(*) AS issues, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS critical FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical FROM customer LEFT JOIN i ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' AND coalesce(critical, 0) > 0""")
def segment_list(spark, sf):
    critical = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")
    i = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("issues"), F.count_if(critical).alias("critical"))
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    j = c.join(i, c.c_custkey == i.o_custkey, "left")
    return j.select("c_custkey", "c_nationkey", "c_mktsegment", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("issues", "critical")]).where("critical > 0")


@query("SELECT o_orderkey, c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND c_nationkey = 7")
def issue_list(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O"))
    c = table(spark, sf, "customer").where("c_nationkey = 7")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey", "o_orderpriority")


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) > 50, false) AS flagged FROM events")
def json_flag(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint") > 50, F.lit(False)).alias("flagged"))


@query("SELECT c_custkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE s_nationkey = 3 OR s_nationkey IS NULL")
def optional_scope(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "left").where("s_nationkey = 3 OR s_nationkey IS NULL").select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_type NOT LIKE '%STEEL' AND p_brand IS NOT NULL AND p_size IN (1, 5, 9, 14, 23) AND regexp_matches(p_name, '[aeiou]')")
def like_filters(spark, sf):
    p = table(spark, sf, "part")
    return p.where(F.col("p_type").like("%A%") & ~F.col("p_type").like("%STEEL") & F.col("p_brand").isNotNull() & F.col("p_size").isin(1, 5, 9, 14, 23) & F.col("p_name").rlike("[aeiou]")).select("p_partkey", "p_type")


@query("""SELECT conv_id, turn, (len(text) - len(replace(lower(text), 'the', ''))) // 3 AS hits, regexp_replace(text, '(?i)the', 'THE', 'g') AS replaced FROM conversations WHERE contains(lower(text), 'the') AND role <> 'system'""")
def find_replace(spark, sf):
    d = table(spark, sf, "conversations").where(F.lower("text").contains("the") & (F.col("role") != "system"))
    return d.select("conv_id", "turn", F.regexp_count("text", F.lit("(?i)the")).cast("long").alias("hits"), F.regexp_replace("text", "(?i)the", "THE").alias("replaced"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS")
def retention(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.col("ts") < F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query(r"SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_name || ' ' || p_type), '\b(steel|tin|brass|tts|whisper|embed|rerank|clip)\b')")
def text_models(spark, sf):
    return table(spark, sf, "part").where(~F.lower(F.concat_ws(" ", "p_name", "p_type")).rlike(r"\b(steel|tin|brass|tts|whisper|embed|rerank|clip)\b")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 4) AS qe_diff FROM lineitem WHERE l_returnflag = 'R'")
def qe_diff(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") - F.col("l_tax"), 4).alias("qe_diff"))


@query("SELECT c_custkey, coalesce(n, 0) AS mentions FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def mention_counts(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf, "customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("mentions"))


@query("""SELECT p_brand, a.capital, a.any_name FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN
 (SELECT p_brand AS b, min(CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN p_name END) AS capital, min(p_name) AS any_name FROM part GROUP BY p_brand) a ON p_brand = b""")
def alias_sort(spark, sf):
    p = table(spark, sf, "part")
    a = p.groupBy("p_brand").agg(F.min(F.when(F.col("p_name").rlike("^[A-Z]"), F.col("p_name"))).alias("capital"), F.min("p_name").alias("any_name"))
    return p.select("p_brand").distinct().join(a, "p_brand", "left")


@query("SELECT c_custkey, row_number() OVER (ORDER BY n_regionkey ASC NULLS LAST, c_acctbal, c_custkey) AS numero FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def numbering(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey < 20")
    c = table(spark, sf, "customer")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_regionkey", "c_acctbal")
    return rk.numbered(j, [], [F.col("n_regionkey").asc_nulls_last(), F.col("c_acctbal"), F.col("c_custkey")], "numero").select("c_custkey", "numero")


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS ordinal FROM customer")
def ordinal_compaction(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = rk.numbered(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], "n")
    return n.select("c_custkey", "c_nationkey", (F.col("n") - 1).alias("ordinal"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_run(spark, sf):
    return rk.latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""WITH undone AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT user_id, max(event_id) AS event_id FROM events e WHERE event_type <> (SELECT min(event_type) FROM events) AND NOT EXISTS (SELECT 1 FROM undone u WHERE u.user_id = e.user_id AND u.k = CAST(json_extract_string(e.props, '$.k') AS BIGINT)) GROUP BY user_id""")
def undo_latest(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    first = F.broadcast(e.agg(F.min("event_type").alias("undo")))
    undone = e.join(first, F.col("event_type") == F.col("undo")).select("user_id", "k").distinct()
    edits = e.join(first, F.col("event_type") != F.col("undo"))
    return edits.join(undone, ["user_id", "k"], "left_anti").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("""SELECT c_nationkey, count(*) AS total, count(*) FILTER (c_mktsegment = 'BUILDING') AS approved, count(*) FILTER (c_mktsegment IN ('MACHINERY', 'FURNITURE')) AS drafts, count(*) FILTER (c_acctbal > 0) AS with_target, bool_and(c_acctbal > -900) AS all_fine FROM customer GROUP BY c_nationkey""")
def status_counts(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy("c_nationkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("approved"), F.count_if(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).alias("drafts"),
        F.count_if(F.col("c_acctbal") > 0).alias("with_target"), F.bool_and(F.col("c_acctbal") > -900).alias("all_fine"),
    )


@query("""WITH i AS (SELECT coalesce(nullif(o_orderstatus, ''), 'unspecified') AS category, coalesce(o_orderpriority, 'minor') AS severity FROM orders),
w AS (SELECT sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) AS words FROM documents)
SELECT category, severity, count(*) AS issues, round(count(*) / max(words) * 1000, 4) AS per_1000_words FROM i, w GROUP BY GROUPING SETS ((category, severity), (category), (severity), ())""")
def mqm_report(spark, sf):
    from ..functions import text as t

    words = table(spark, sf, "documents").agg(F.sum(F.size(t.words("text")).cast("long")).alias("words"))
    i = table(spark, sf, "orders").select(F.coalesce(F.nullif("o_orderstatus", F.lit("")), F.lit("unspecified")).alias("category"), F.coalesce("o_orderpriority", F.lit("minor")).alias("severity"))
    i.createOrReplaceTempView("_issues")
    counts = spark.sql("SELECT category, severity, count(*) AS issues FROM _issues GROUP BY GROUPING SETS ((category, severity), (category), (severity), ())")
    # one row of words joins the few rows of the report
    return counts.join(F.broadcast(words), F.lit(True)).select("category", "severity", "issues", F.round(F.col("issues") / F.col("words") * 1000, 4).alias("per_1000_words"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) AS jobs, count(*) FILTER (ts >= now - INTERVAL 24 HOURS) AS last_day, round(sum(value), 4) AS seconds, round(sum(value) / count(*), 4) AS per_job, round(sum(value) / count(*) * count(*) FILTER (ts >= now - INTERVAL 24 HOURS), 3) AS eta FROM events, m GROUP BY event_type""")
def progress_eta(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    e = e.join(F.broadcast(now), F.lit(True))
    recent = F.count_if(F.col("ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    return e.groupBy("event_type").agg(F.count("*").alias("jobs"), recent.alias("last_day"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.sum("value") / F.count("*"), 4).alias("per_job"), F.round(F.sum("value") / F.count("*") * recent, 3).alias("eta"))


@query("""WITH r AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations),
g AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM r)
SELECT conv_id, CAST(island AS BIGINT) AS island, any_value(role) AS title, count(*) AS segments, CAST(sum(len(text)) AS BIGINT) AS chars, CAST(greatest(1, round(sum(len(text)) / 3400.0)) AS BIGINT) AS pages FROM g GROUP BY conv_id, island""")
def outline(spark, sf):
    d = table(spark, sf, "conversations")
    fresh = ~F.col("role").eqNullSafe(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    g = rk.islands(d.withColumn("fresh", fresh), ["conv_id"], ["turn"], F.col("fresh"))
    chars = F.sum(F.length("text").cast("long"))
    return g.groupBy("conv_id", "island").agg(F.any_value("role").alias("title"), F.count("*").alias("segments"), chars.alias("chars"), F.greatest(F.lit(1), F.round(chars / 3400)).cast("long").alias("pages"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 15 ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def entity_page(spark, sf):
    c = table(spark, sf, "customer").where("c_nationkey < 15").select("c_custkey", "c_name", "c_acctbal")
    return rk.page(c, [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 3, 25)


@query(r"""SELECT p_brand, p_type, natural_key, rank() OVER (PARTITION BY p_type ORDER BY natural_key) AS position FROM (
 SELECT DISTINCT p_brand, p_type, array_to_string(list_transform(regexp_extract_all(p_brand, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d+$') THEN lpad(p, 12, '0') ELSE lower(p) END), '') AS natural_key FROM part)""")
def natural_sort(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", rk.natural_key("p_brand").alias("natural_key")).distinct()
    return p.withColumn("position", F.rank().over(Window.partitionBy("p_type").orderBy("natural_key")).cast("long"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END DESC, o_orderkey) AS position FROM orders""")
def severity_sort(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(0)
    o = table(spark, sf, "orders")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank.desc(), "o_orderkey")).cast("long").alias("position"))


@query("""SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(s_acctbal, 1073741824), c_acctbal ASC NULLS LAST, c_custkey) AS position FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def book_order(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    j = c.join(s, c.c_custkey == s.s_suppkey, "left").select("c_nationkey", "c_custkey", F.coalesce("s_acctbal", F.lit(1073741824.0)).alias("o"), "c_acctbal")
    return rk.numbered(j, ["c_nationkey"], [F.col("o"), F.col("c_acctbal").asc_nulls_last(), F.col("c_custkey")], "position").select("c_nationkey", "c_custkey", "position")


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority""")
def issue_dedupe(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""SELECT o_orderkey, 'human' AS origin FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'machine' FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.08""")
def issue_replace(spark, sf):
    human = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit("human").alias("origin"))
    new = table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_discount > 0.08").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o_orderkey"), F.lit("machine").alias("origin"))
    return human.unionByName(new)


@query("""SELECT lower(alias) AS alias_key, min(alias) AS alias, count(*) AS n FROM (SELECT p_name AS alias FROM part UNION ALL SELECT p_type FROM part) GROUP BY lower(alias)""")
def alias_union(spark, sf):
    p = table(spark, sf, "part")
    a = p.select(F.col("p_name").alias("alias")).union(p.select("p_type"))
    return a.groupBy(F.lower("alias").alias("alias_key")).agg(F.min("alias").alias("alias"), F.count("*").alias("n"))


@query("""SELECT source, sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY source, sha256(text) HAVING count(*) > 1""")
def duplicate_uploads(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return d.where("copies > 1")


#: fixed values: which state of a project may follow which
EDGES = [("draft", "importing"), ("importing", "structuring"), ("structuring", "segmenting"), ("segmenting", "translating"), ("translating", "reviewing"), ("reviewing", "translating"), ("reviewing", "exporting"), ("exporting", "done")]


@query("""WITH e(a, b) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + """), s AS (SELECT DISTINCT a AS s FROM e UNION SELECT DISTINCT b FROM e)
SELECT x.s AS current_state, y.s AS target, e.a IS NOT NULL AS allowed FROM s x JOIN s y ON x.s <> y.s LEFT JOIN e ON e.a = x.s AND e.b = y.s""")
def state_edges(spark, sf):
    e = spark.createDataFrame(EDGES, "a string, b string")
    s = e.select(F.col("a").alias("s")).union(e.select("b")).distinct()
    x, y = s.withColumnRenamed("s", "current_state"), s.withColumnRenamed("s", "target")
    pairs = x.join(F.broadcast(y), F.col("current_state") != F.col("target"))
    return pairs.join(F.broadcast(e), (F.col("a") == F.col("current_state")) & (F.col("b") == F.col("target")), "left").select("current_state", "target", F.col("a").isNotNull().alias("allowed"))


@query("SELECT c_nationkey, max(c_custkey) + 1 AS next_numero FROM customer GROUP BY c_nationkey")
def next_numero(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next_numero"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in _TABLES))
def backup_counts(spark, sf):
    out = None
    for x in _TABLES:
        one = table(spark, sf, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT round(corr(CAST(quality AS DOUBLE), s), 4) AS pearson, round(avg(abs(quality - s)), 4) AS mae, count(*) AS n FROM (SELECT quality, least(1.0, n_chars / 2000.0) AS s FROM labels JOIN documents USING (doc_id))")
def qe_calibration(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").cast("double").alias("h"), F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("s"))
    flat = (F.stddev_pop("h") == 0) | (F.stddev_pop("s") == 0)
    n = F.count("*")
    return j.agg(F.when(n < 2, F.lit(None)).when(flat, 0.0).otherwise(F.round(F.corr("h", "s"), 4)).alias("pearson"), F.when(n >= 2, F.round(F.avg(F.abs(F.col("h") - F.col("s"))), 4)).alias("mae"), n.alias("n"))


@query("""SELECT vec_id, other, score FROM (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE r <= 5""")
def cosine_topk(spark, sf):
    from ..operators import vectors

    return vectors.nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 5)
