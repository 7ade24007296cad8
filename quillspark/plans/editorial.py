"""Queries over what editors do with entities, terms, issues and units.

Stand-ins: parts are entities, turns are units and blocks, lines of documents with made-up places are pages.
"""

from __future__ import annotations

from pyspark.sql import Window as _Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as t
from ..operators import editorial as ed
from ..operators import layout as lo
from ..operators import lines as ln
from ..session import table
from .layout import PAGED
from .exchange import UNITS, units
from .memory import PAIRS, pairs
from .texts import LINES

ENTS = """ents AS (SELECT p_partkey AS id, p_type, p_size, p_name AS src, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || ' ' || string_split(p_name, ' ')[2] WHEN 2 THEN ' ' || upper(p_name) END AS tgt,
 [string_split(p_name, ' ')[1], CASE WHEN p_size % 2 = 0 THEN upper(string_split(p_name, ' ')[2]) ELSE p_name END, lower(p_type) || ' x', CASE WHEN p_size % 3 = 0 THEN p_type ELSE lower(p_brand) END] AS aliases FROM part),
sing AS (SELECT *, list_filter(aliases, lambda a: regexp_matches(a, '^\\s*\\S+\\s*$')) AS one FROM ents),
held AS (SELECT *, list_filter(one, lambda a: contains(lower(src), lower(a))) AS inn FROM sing),
shown AS (SELECT *, coalesce(list_filter(inn, lambda a: regexp_matches(a, '^[A-Z]'))[1], inn[1]) AS shown,
 CASE WHEN len(list_filter(one, lambda a: regexp_matches(a, '^[A-Z]'))) > 0 THEN 'upper' WHEN len(one) > 0 THEN 'lower' END AS alias_case FROM held),
rel AS (SELECT *, coalesce(trim(tgt) <> '' AND lower(trim(tgt)) = lower(trim(src)), false) AS identical,
 coalesce(len(list_intersect(string_split(lower(src), ' '), string_split(lower(trim(tgt)), ' '))) > 0, false) AS shares_word,
 coalesce(lower(trim(tgt)) = lower(trim(src)) AND lower(shown) = lower(trim(tgt)), false) AS same_as_alias FROM shown)"""


def entities(spark, sf):
    word = lambda k: F.get(F.split("p_name", " "), F.lit(k))
    aliases = F.array(word(0), F.when(F.col("p_size") % 2 == 0, F.upper(word(1))).otherwise(F.col("p_name")), F.concat(F.lower("p_type"), F.lit(" x")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.lower("p_brand")))
    k = F.col("p_partkey") % 4
    target = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_type", word(1))).when(k == 2, F.concat(F.lit(" "), F.upper("p_name")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size", F.col("p_name").alias("canonical_source"), target.alias("canonical_target"), aliases.alias("aliases"))


@query(f"WITH {ENTS} SELECT id, alias_case FROM rel")
def alias_case(spark, sf):
    return entities(spark, sf).select("id", ed.alias_case(F.col("aliases")).alias("alias_case"))


@query(f"WITH {ENTS} SELECT id, shown FROM rel")
def alias_shown(spark, sf):
    return entities(spark, sf).select("id", ed.shown_alias(F.col("aliases"), F.col("canonical_source")).alias("shown"))


@query(f"WITH {ENTS} SELECT id, identical, shares_word, same_as_alias FROM rel")
def translation_relation(spark, sf):
    e = entities(spark, sf)
    return e.select("id", *[c.alias(k) for k, c in ed.translation_relation(F.col("canonical_source"), F.col("canonical_target"), F.col("aliases")).items()])


@query(f"""WITH {ENTS}, f AS (SELECT id, src FROM rel WHERE p_type = 'ECONOMY' AND alias_case = 'upper' AND shares_word)
SELECT id, src AS canonical_source, (SELECT count(*) FROM f) AS total FROM f ORDER BY src, id LIMIT 5 OFFSET 5""")
def entity_list(spark, sf):
    """The second page of filtered entities, with the number of all of them."""
    e = ed.entities_where(entities(spark, sf), alias="upper", translation="shares_word", p_type="ECONOMY")
    return ed.listed(e.select("id", "canonical_source"), [F.col("canonical_source"), F.col("id")], 2, 5)


@query("""WITH a AS (SELECT c_nationkey AS k, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS alias FROM customer UNION ALL SELECT c_nationkey, lower(c_name) FROM customer WHERE c_nationkey % 2 = 0),
b AS (SELECT k, min(CASE WHEN regexp_matches(alias, '^[A-Z]') THEN alias END) AS up, min(alias) AS any_ FROM a WHERE NOT contains(alias, ' ') AND k % 5 <> 0 GROUP BY k)
SELECT n_nationkey AS k, coalesce(up, any_) AS alias FROM nation LEFT JOIN b ON n_nationkey = k""")
def alias_picked(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey"))
    a = c.select("k", F.concat("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, " x").otherwise("")).alias("alias")).union(c.where("k % 2 = 0").select("k", F.lower("c_name"))).where("k % 5 <> 0")
    return ed.alias_pick(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), a, "k")


@query("SELECT o.lang AS source, n.lang AS target, o.lang = 'en' AND n.lang IN ('it', 'es', 'fr', 'de', 'pt') AS supported FROM (SELECT DISTINCT lang FROM documents) o, (SELECT DISTINCT lang FROM documents UNION SELECT 'it') n")
def supported_pairs(spark, sf):
    langs = table(spark, sf, "documents").select("lang").distinct()
    pair = langs.select(F.col("lang").alias("source")).join(langs.union(spark.createDataFrame([("it",)], "lang string")).distinct().select(F.col("lang").alias("target")), F.lit(True))
    return pair.withColumn("supported", ed.supported(F.col("source"), F.col("target")))


@query("SELECT days, event_id FROM events, (VALUES (0), (3), (7)) AS d(days) WHERE days > 0 AND ts < TIMESTAMP '2024-01-20' - to_days(days)")
def retention_days(spark, sf):
    e, now = table(spark, sf, "events"), F.lit("2024-01-20").cast("timestamp")
    out = [ed.expired(e, "ts", days, now).select(F.lit(days).alias("days"), "event_id") for days in (0, 3, 7)]
    return out[0].union(out[1]).union(out[2])


UNITS_SQL = """u AS (SELECT l_orderkey * 10 + l_linenumber AS unit, CASE l_returnflag WHEN 'R' THEN 'approved' WHEN 'A' THEN 'machine_draft' ELSE 'untranslated' END AS status, l_linestatus = 'O' AS has_qa, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS qa_critical,
 CASE WHEN l_linenumber < 4 THEN l_discount END AS is_translated, CASE WHEN l_linenumber < 5 THEN l_discount - l_tax END AS qe_diff FROM lineitem)"""


def review_units(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "approved").when(F.col("l_returnflag") == "A", "machine_draft").otherwise("untranslated")
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("unit"), status.alias("status"), F.lit(None).cast("boolean").alias("ocr_suspect"), (F.col("l_linestatus") == "O").alias("has_qa"), F.when(n == 1, 1).otherwise(0).alias("qa_critical"), F.when(n < 4, F.col("l_discount")).alias("is_translated"), F.when(n < 5, F.col("l_discount") - F.col("l_tax")).alias("qe_diff"))


@query(f"""WITH {UNITS_SQL} SELECT 'qa' AS filter, unit FROM u WHERE has_qa OR qa_critical > 0
UNION ALL SELECT 'draft, neg', unit FROM u WHERE status = 'machine_draft' AND coalesce(qe_diff, 1) <= 0
UNION ALL SELECT 'pos, 0.02 to 0.08', unit FROM u WHERE coalesce(qe_diff, -1) > 0 AND coalesce(is_translated, -1) > 0.02 AND coalesce(is_translated, 2) < 0.08
UNION ALL SELECT 'ocr', unit FROM u WHERE false""")
def review_filters(spark, sf):
    u = review_units(spark, sf)
    out = [("qa", ed.reviewed(u, target="qa")), ("draft, neg", ed.reviewed(u, target="draft", diff="neg")), ("pos, 0.02 to 0.08", ed.reviewed(u, diff="pos", above=0.02, below=0.08)), ("ocr", ed.reviewed(u, source="ocr"))]
    frames = [df.select(F.lit(name).alias("filter"), "unit") for name, df in out]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@query("""WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'approved' ELSE 'machine_draft' END AS status, text AS target FROM conversations)
SELECT conv_id, turn, 'any' AS mode, CASE WHEN status = 'approved' THEN target ELSE regexp_replace(target, '(?i)the', '$1.\\\\E', 'g') END AS replaced, status = 'approved' AS read_only FROM u WHERE contains(lower(target), 'the')
UNION ALL SELECT conv_id, turn, 'exact', CASE WHEN status = 'approved' THEN target ELSE replace(target, 'The', 'A') END, status = 'approved' FROM u WHERE contains(target, 'The')""")
def find_cases(spark, sf):
    """Found in any case and in the exact one; approved units are shown, not changed."""
    u = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "approved").otherwise("machine_draft").alias("status"), F.col("text").alias("target"))
    one = lambda df, mode: df.select("conv_id", "turn", F.lit(mode).alias("mode"), "replaced", "read_only")
    return one(ed.found(u, "the", "$1.\\E", False), "any").union(one(ed.found(u, "The", "A", True), "exact"))


@query(f"""WITH {PAGED}, o AS (SELECT source, page_number, sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - len(text) - 1 AS a, sum(len(text) + 1) OVER (PARTITION BY source ORDER BY page_number) - 1 AS z FROM paged),
m AS (SELECT event_id, 'src' || (user_id % 20) AS source, event_id * 11 AS at FROM events), l AS (SELECT source, max(z) AS z, max(page_number) AS p FROM o GROUP BY source)
SELECT event_id, o.page_number FROM m JOIN o ON m.source = o.source AND m.at BETWEEN o.a AND o.z UNION ALL SELECT event_id, l.p FROM m JOIN l ON m.source = l.source WHERE m.at > l.z""")
def offset_clamped(spark, sf):
    o = lo.offsets(lo.pages(table(spark, sf, "documents"))).drop("doc_id")
    m = table(spark, sf, "events").select("event_id", F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), (F.col("event_id") * 11).alias("at"))
    return ed.clamped_pages(m, o, ["source"], "at", 1 << 14).select("event_id", "page_number")


@query("""WITH e AS (SELECT p_type || ' ' || p_brand AS source, lower(p_name) AS target, min(p_partkey) AS entry_id FROM part GROUP BY ALL)
SELECT a.source, a.entry_id AS first, b.entry_id AS second FROM e a JOIN e b ON a.source = b.source AND a.entry_id < b.entry_id""")
def contradiction_pairs(spark, sf):
    return ed.contradiction_pairs(table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.concat_ws(" ", "p_type", "p_brand").alias("source"), F.upper("p_name").alias("target")))


@query("""WITH e AS (SELECT DISTINCT c_nationkey AS chapter, c_mktsegment AS entity FROM customer WHERE c_custkey % 4 = 0), f AS (SELECT c_nationkey AS chapter, min(c_custkey) AS first FROM customer WHERE c_custkey % 4 = 0 GROUP BY c_nationkey),
o AS (SELECT chapter, lag(chapter) OVER (ORDER BY first, chapter) AS before FROM f)
SELECT 1 AS book, o.chapter, (SELECT count(*) FROM e WHERE e.chapter = o.chapter) AS present,
 (SELECT count(*) FROM e WHERE e.chapter = o.chapter AND e.entity NOT IN (SELECT entity FROM e x WHERE x.chapter = o.before)) AS introduced,
 (SELECT count(*) FROM e WHERE e.chapter = o.before AND e.entity NOT IN (SELECT entity FROM e x WHERE x.chapter = o.chapter)) AS returned FROM o""")
def chapter_changes(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 4 = 0")
    return ed.chapter_changes(c.select(F.lit(1).alias("book"), F.col("c_nationkey").alias("chapter"), F.col("c_custkey").alias("page"), F.col("c_mktsegment").alias("entity")))


@query("""WITH n AS (SELECT o_orderkey AS node_id, o_custkey AS book, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS start_page, CASE WHEN o_orderstatus = 'P' THEN 'scene' ELSE 'chapter' END AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 11 END AS ordinal FROM orders)
SELECT node_id, book, row_number() OVER (PARTITION BY book ORDER BY start_page IS NULL, coalesce(start_page, 0), kind = 'scene', coalesce(ordinal, 0), node_id) - 1 AS ordinal FROM n""")
def ordinals_compacted(spark, sf):
    k = F.col("o_orderkey")
    n = table(spark, sf, "orders").select(k.alias("node_id"), F.col("o_custkey").alias("book"), F.when(k % 5 != 0, F.year("o_orderdate")).alias("start_page"), F.when(F.col("o_orderstatus") == "P", "scene").otherwise("chapter").alias("kind"), F.when(k % 7 != 0, k % 11).alias("ordinal"))
    return ed.compacted(n, ["book"]).select("node_id", "book", "ordinal")


@query(r"""WITH t AS (SELECT conv_id, turn, text, strpos(text, 'th') - 1 AS s FROM conversations WHERE contains(text, 'th')),
p AS (SELECT *, greatest(s - 60, 0) AS a, least(s + 62, len(text)) AS z FROM t),
q AS (SELECT *, a - len(regexp_extract(substr(text, 1, a), '(\S*)$', 1)) AS lo, len(regexp_extract(substr(text, z), '^(\S*)', 1)) AS run FROM p)
SELECT conv_id, turn, regexp_replace(substr(text, lo + 1, CASE WHEN run > 0 THEN least(z + run, len(text)) ELSE z END - lo), '^\s+|\s+$', '', 'g') AS quote FROM q""")
def quote_context(spark, sf):
    """What stands around the first `th` of each turn."""
    c = table(spark, sf, "conversations").withColumn("s", F.instr("text", "th") - 1).where("s >= 0")
    return c.select("conv_id", "turn", ed.quote(F.col("text"), F.col("s"), F.col("s") + 2).alias("quote"))


PLACED = f"""{LINES}, pl AS (SELECT doc_id, line_no, trim(line) AS line, CAST(line_no * 12 + (line_no // 4) * 9 + (line_no % 3) AS DOUBLE) AS y0 FROM lines WHERE trim(line) <> ''),
gp AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap, regexp_matches(line, '^[*#•.\\s~\\-—–]{{3,}}$') AS scene FROM pl),
ld AS (SELECT doc_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS g FROM gp GROUP BY doc_id),
lead_ AS (SELECT doc_id, coalesce(g[len(g) // 4 + 1], 0.0) AS "leading" FROM ld),
fr AS (SELECT gp.*, "leading", CASE WHEN coalesce("leading" > 0 AND gap > 1.45 * "leading", false) OR line[1] IN ('“', '"', '«', '‘', '’', '”', '''') OR scene OR coalesce(lag(scene) OVER (PARTITION BY gp.doc_id ORDER BY line_no), true) THEN 1 ELSE 0 END AS fresh FROM gp JOIN lead_ USING (doc_id)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS para_no FROM fr)"""


def placed(spark, sf):
    n = F.col("line_no")
    return ln.lines(table(spark, sf, "documents")).withColumn("y0", (n * 12 + F.floor(n / 4) * 9 + n % 3).cast("double"))


@query(f'WITH {PLACED} SELECT doc_id, "leading" FROM lead_')
def page_leading(spark, sf):
    """Each page's usual step from line to line: the first quartile."""
    return ed.line_groups(placed(spark, sf), ["doc_id"]).groupBy("doc_id").agg(F.first("leading").alias("leading"))


@query(f"WITH {PLACED} SELECT doc_id, CAST(para_no AS BIGINT) AS para_no, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM gr GROUP BY doc_id, para_no")
def gap_paragraphs(spark, sf):
    g = ed.line_groups(placed(spark, sf), ["doc_id"]).groupBy("doc_id", "para_no")
    g = g.agg(F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("doc_id", "para_no", "lines", F.array_join("l.line", "\n").alias("text"))


@query(r"""WITH p AS (SELECT conv_id % 7 AS book, conv_id AS page, turn AS para_no, text, false AS is_verse, CASE WHEN trim(text) = '' THEN 'paragraph' WHEN trim(text)[1] IN ('“', '"', '«', '‘', '’', '”', '''', '—', '–') THEN 'dialogue' ELSE 'paragraph' END AS kind FROM
 (SELECT conv_id, turn, CASE WHEN turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id) AND conv_id % 2 = 0 THEN 'unfinished words' WHEN turn = 0 AND conv_id % 3 <> 0 THEN 'and on they go' ELSE 'One sentence.' END AS text FROM conversations)),
k AS (SELECT book, page, row_number() OVER (PARTITION BY book ORDER BY page) AS k FROM (SELECT DISTINCT book, page FROM p)),
l AS (SELECT *, lag(text) OVER (PARTITION BY book ORDER BY page, para_no) AS before, lag(page) OVER (PARTITION BY book ORDER BY page, para_no) AS page_before FROM p),
f AS (SELECT *, CASE WHEN page_before IS NOT NULL AND page_before <> page AND NOT regexp_matches(before, '[.!?…]$') AND NOT regexp_matches(text, '^\p{Lu}') THEN 0 ELSE 1 END AS fresh FROM l),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY book ORDER BY page, para_no) AS n FROM f)
SELECT book, CAST(n AS BIGINT) AS para_no, min(page) AS page, min(kind) AS kind, count(*) AS pieces, string_agg(text, ' ' ORDER BY page, para_no) AS text FROM n GROUP BY book, n""")
def continued_paragraphs(spark, sf):
    """Paragraphs over page ends: the first turn of every conversation may go on the last one of the one before."""
    c = table(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    text = F.when((F.col("turn") == F.col("last")) & (F.col("conv_id") % 2 == 0), "unfinished words").when((F.col("turn") == 0) & (F.col("conv_id") % 3 != 0), "and on they go").otherwise("One sentence.")
    p = c.join(last, "conv_id").select((F.col("conv_id") % 7).alias("book"), F.col("conv_id").alias("page"), F.col("turn").alias("para_no"), text.alias("text"), F.lit(False).alias("is_verse"))
    return ed.continued(p.withColumn("kind", t.paragraph_kind("text")))


#: entities of the stand-ins: id, source, aliases
NAMED = [(1, "thing 10", ["block", "the other"]), (2, "thing 9", ["eand"]), (3, "You", []), (4, "stone", ["ing"]), (5, "Nobody at all", [])]
NAMED_SQL = "named(entity_id, src, names, nat) AS (VALUES " + ", ".join(f"({i}, '{s}', {[x.lower() for x in [s, *a]]!r}, '{n}')" for (i, s, a), n in zip(NAMED, ("thing 000000000010", "thing 000000000009", "you", "stone", "nobody at all"), strict=True)) + ")"


@query(f"""WITH {NAMED_SQL}, b AS (SELECT conv_id, turn, lower(text) AS t, coalesce(lower(lag(text, 2) OVER w), '') || ' ' || coalesce(lower(lag(text) OVER w), '') AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, entity_id, nat, CASE WHEN len(list_filter(names, lambda n: contains(t, n))) > 0 THEN 3 WHEN len(list_filter(names, lambda n: contains(p, n))) > 0 THEN 2 WHEN entity_id = 1 + conv_id % 5 AND turn = 1 THEN 1 ELSE 0 END AS priority FROM b, named),
r AS (SELECT conv_id || ':' || turn AS block_id, entity_id, priority, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority DESC, nat, entity_id) AS position FROM s WHERE priority > 0) SELECT * FROM r WHERE position <= 3""")
def entities_for_blocks(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = lambda n: F.coalesce(F.lag("text", n).over(w), F.lit(""))
    ident = F.concat_ws(":", "conv_id", "turn").alias("block_id")
    b = c.select(ident, "text", F.concat(before(2), F.lit(" "), before(1)).alias("preceding"))
    reached = c.where("turn = 1").select(ident, (F.col("conv_id") % 5 + 1).alias("entity_id"))
    return ed.entities_for_blocks(b, spark.createDataFrame(NAMED, "entity_id long, canonical_source string, aliases array<string>"), reached, 3)


@query("""WITH r AS (SELECT o_custkey AS batch, list(o_orderkey ORDER BY o_orderkey) AS want, list(CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1000000 ELSE o_orderkey END ORDER BY CASE WHEN o_custkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END) FILTER (o_custkey % 7 <> 0 OR o_orderkey % 2 = 0) AS got FROM orders GROUP BY o_custkey),
x AS (SELECT batch, want, coalesce(got, []) AS got FROM r),
h AS (SELECT batch, 'cardinality' AS kind, NULL AS segment_id, NULL AS place FROM x WHERE len(want) <> len(got)
 UNION ALL SELECT batch, 'id_missing', unnest(list_filter(want, lambda i: NOT list_contains(got, i))), NULL FROM x UNION ALL SELECT batch, 'id_extra', unnest(list_filter(got, lambda i: NOT list_contains(want, i))), NULL FROM x)
SELECT batch, kind, CAST(segment_id AS BIGINT) AS segment_id, CAST(place AS BIGINT) AS place FROM (SELECT * FROM h
 UNION ALL SELECT batch, 'id_order', w, i FROM (SELECT batch, got, unnest(want) AS w, unnest(range(0, len(want))) AS i FROM x WHERE batch NOT IN (SELECT batch FROM h)) WHERE w <> got[i + 1])""")
def id_errors(spark, sf):
    k, odd = F.col("o_orderkey"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    got = F.when((F.col("o_custkey") % 7 != 0) | (k % 2 == 0), F.struct(odd.alias("at"), F.when(F.col("o_orderstatus") == "P", k + 1000000).otherwise(k).alias("id")))
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("want"), F.sort_array(F.collect_list(got)).alias("x"))
    return ed.id_errors(r.select("batch", "want", F.col("x.id").alias("got")))


@query(f"""WITH {PAIRS}, p AS (SELECT conv_id || ':' || turn AS segment_id, source, target, lower(target) AS low, len(regexp_extract_all(source, '[A-Za-zÀ-ɏ]+|[0-9]+')) AS a, len(regexp_extract_all(target, '[A-Za-zÀ-ɏ]+|[0-9]+')) AS b FROM bi)
SELECT segment_id, 'forbidden_term' AS category, 'critical' AS severity, w AS evidence FROM p, (VALUES ('idiot'), ('stupid'), ('ing')) AS f(w) WHERE contains(low, w)
UNION ALL SELECT segment_id, 'wrong_term', 'major', w FROM p, (VALUES ('the'), ('you')) AS k(w) WHERE NOT contains(low, w)
UNION ALL SELECT segment_id, 'omission', 'major', substr(target, 1, 120) FROM p WHERE b < 0.4 * greatest(a, 1)""")
def critic_rules(spark, sf):
    p = pairs(spark, sf).select(F.concat_ws(":", "conv_id", "turn").alias("segment_id"), "source", "target")
    return ed.criticised(p, ["Idiot", "stupid", "ing"], ["the", "You"])


@query(f"""WITH {ENTS}, c AS (SELECT id, p_type, src, p_size / 50.0 AS confidence, CASE p_size % 5 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'CREATURE_SPECIES' WHEN 2 THEN NULL WHEN 3 THEN 'LOCATION' ELSE 'WORK_MEDIA' END AS entity_type FROM ents),
x AS (SELECT p_type, lower(string_agg(p_name, ', ' ORDER BY p_partkey)) AS low FROM part WHERE p_partkey < 60 GROUP BY p_type),
j AS (SELECT c.*, low FROM c JOIN x USING (p_type) WHERE (coalesce(entity_type, '') = 'CREATURE_SPECIES' OR confidence < 0.55 OR coalesce(entity_type, '') IN ('CONCEPT_TERM', 'WORK_MEDIA', '', 'UNKNOWN')) AND regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}])' || lower(src) || '($|[^\\p{{L}}\\p{{N}}])'))
SELECT p_type, id AS place, 'cand:' || substr(sha256(lower(src)), 1, 12) AS candidate_id, position FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY id) AS position FROM j) WHERE position <= 128""")
def model_candidates(spark, sf):
    """What a model is to classify in the chapters (types of parts) of the stand-in."""
    k = F.col("p_size") % 5
    kind = F.when(k == 0, "PERSON").when(k == 1, "CREATURE_SPECIES").when(k == 3, "LOCATION").when(k == 4, "WORK_MEDIA")
    e = entities(spark, sf).select("p_type", F.col("id").alias("place"), "canonical_source", (F.col("p_size") / 50.0).alias("confidence"), kind.alias("entity_type"))
    names = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name")))
    texts = table(spark, sf, "part").where("p_partkey < 60").groupBy("p_type").agg(names.alias("n")).select("p_type", F.array_join("n.p_name", ", ").alias("text"))
    c = ed.candidates(e, texts, "p_type")
    return c.select("p_type", "place", "candidate_id", "position")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', '') THEN 'LOCATION' ELSE 'PERSON' END AS entity_type, CASE WHEN o_orderkey % 3 = 0 THEN 'said' ELSE 'own' END AS definition, round(least(1.0, CASE WHEN o_orderkey % 4 = 0 THEN 0.8 ELSE 0.4 + 0.5 * ((o_orderkey % 100) / 100.0) END) + 1e-9, 3) AS confidence FROM orders""")
def fields_merged(spark, sf):
    """Entities after a model's answer: orders of status O are of a weak type."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "CONCEPT_TERM").otherwise("PERSON").alias("entity_type"), F.when(k % 3 == 0, " ").otherwise("own").alias("definition"), F.when(k % 4 != 0, (k % 100) / 100.0).alias("confidence"))
    said = {"category": F.lit("LOCATION"), "definition": F.lit("said"), "confidence": F.lit(0.8)}
    return o.select("o_orderkey", *[c.alias(n) for n, c in ed.merged_fields(F.col("entity_type"), F.col("definition"), F.col("confidence"), said).items()])


KINDS = ("PERSON", "ROLE", "CREATURE_SPECIES", "ORG_FACTION", "OBJECT_ARTIFACT", "TITLE_HONORIFIC", "OTHER")


@query("""WITH k AS (SELECT p_partkey, ['PERSON', 'ROLE', 'CREATURE_SPECIES', 'ORG_FACTION', 'OBJECT_ARTIFACT', 'TITLE_HONORIFIC', 'OTHER'][p_partkey % 7 + 1] AS kind FROM part)
SELECT p_partkey, CASE WHEN kind IN ('CREATURE_SPECIES', 'ORG_FACTION') THEN 'unknown' WHEN kind <> 'OTHER' THEN 'singular' END AS grammatical_number, CASE WHEN kind NOT IN ('PERSON', 'ROLE') THEN 'not_applicable' END AS target_gender,
 CASE WHEN kind <> 'ROLE' THEN 'undecided' END AS translation_policy, CASE WHEN kind NOT IN ('PERSON', 'ROLE') THEN 'not_applicable' END AS referential_gender FROM k""")
def type_defaults(spark, sf):
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind")).select("p_partkey", *[c.alias(n) for n, c in ed.type_defaults(F.col("kind")).items()])


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN event_type ELSE NULL END AS target FROM events""")
def answer_fields(spark, sf):
    """Targets of model items that name the field in several ways."""
    k = F.col("event_id") % 5
    e = table(spark, sf, "events").select("event_id", F.when(k == 0, F.col("event_type")).otherwise("").alias("target_text"), F.when(k == 1, "b").alias("translation"), F.when(k == 2, "c").alias("translated_text"), F.when(k == 3, F.col("event_type")).alias("target"), F.lit("").alias("text"))
    return e.select("event_id", ed.answered_target([F.col(x) for x in ed.TARGET_FIELDS]).alias("target"))


@query("""WITH i AS (SELECT o_custkey AS run, o_orderkey % 50 AS id, CASE WHEN o_orderkey % 97 <> 0 THEN 'LOCATION' END AS category, (o_orderkey % 103) / 100.0 AS confidence, substr(o_orderpriority, 1, 1 + o_orderkey % 8) AS q FROM orders),
bad AS (SELECT run FROM i WHERE category IS NULL OR confidence > 1)
SELECT run, id, category, confidence, trim(q) AS evidence_quote, CAST(NULL AS VARCHAR) AS definition FROM i WHERE run NOT IN (SELECT run FROM bad) AND len(trim(q)) >= 4 AND id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 30)""")
def valid_answers(spark, sf):
    k = F.col("o_orderkey")
    item = F.struct((k % 50).alias("id"), F.when(k % 97 != 0, "LOCATION").alias("category"), ((k % 103) / 100.0).alias("confidence"), F.substring("o_orderpriority", F.lit(1), (1 + k % 8).cast("int")).alias("evidence_quote"), F.lit(" ").alias("definition"))
    runs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.collect_list(item).alias("items"))
    return ed.valid_answers(runs, table(spark, sf, "supplier").where("s_suppkey < 30").select(F.col("s_suppkey").alias("id")))


@query("""WITH b AS (SELECT doc_id, n_chars AS total, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 512 END AS output, CASE WHEN doc_id % 4 <> 0 THEN 4096 * (1 + doc_id % 5) END AS win FROM documents),
n AS (SELECT *, total + CASE WHEN output > 0 THEN output ELSE 16384 END AS needed FROM b)
SELECT doc_id, CAST(needed AS BIGINT) AS needed, CAST(CASE WHEN win IS NULL THEN 0 ELSE win - needed END AS BIGINT) AS headroom, CASE WHEN win IS NULL THEN 'unknown' WHEN win >= needed THEN 'ok' ELSE 'insufficient' END AS status FROM n""")
def window_check(spark, sf):
    k = F.col("doc_id")
    output, window = F.when(k % 3 == 0, 0).when(k % 3 == 1, 512), F.when(k % 4 != 0, 4096 * (1 + k % 5))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in ed.budget_check(F.col("n_chars"), output, window).items()])


@query("""SELECT 'customer' AS entity, c_custkey AS entity_id, CASE WHEN c_custkey % 10 = 0 THEN 'create' WHEN c_custkey % 10 = 1 THEN 'delete' ELSE 'update' END AS action FROM customer WHERE c_custkey % 10 IN (0, 1, 2)""")
def audit_rows(spark, sf):
    """Rows for the audit log of a table's change: some made, some gone, some changed."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey") % 10
    before, after = c.where(k != 0), c.where(k != 1).withColumn("c_name", F.when(k == 2, "new").otherwise(F.col("c_name")))
    a = ed.audited(before, after, "c_custkey", "customer")
    return a.where((F.col("before").isNull() == (F.col("action") == "create")) & (F.col("after").isNull() == (F.col("action") == "delete"))).select("entity", "entity_id", "action")


@query("""WITH c AS (SELECT c_nationkey AS book, c_custkey AS start_page, 'Book ' || CASE c_custkey % 3 WHEN 0 THEN 'One' WHEN 1 THEN 'Two' ELSE 'Three' END || ' / ' || c_mktsegment AS label FROM customer WHERE c_nationkey % 6 <> 0),
n AS (SELECT book FROM c GROUP BY book HAVING count(*) >= 4 AND book % 6 <> 0),
w AS (SELECT book, lower(CASE WHEN (SELECT count(DISTINCT string_split(label, ' ')[2][1]) FROM c x WHERE x.book = c.book) = 1 THEN '' ELSE string_split(label, ' ')[2] END) AS word, start_page FROM c WHERE book IN (SELECT book FROM n)),
g AS (SELECT book, word, count(*) AS members, min(start_page) AS start_page, max(start_page) + 1 AS end_page FROM w GROUP BY book, word)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY start_page) AS part, members, start_page, end_page, round(least(0.85, 0.6 + 0.05 * members), 4) AS confidence FROM g""")
def part_groups(spark, sf):
    """Parts of books by the word after what all chapter labels share."""
    c = table(spark, sf, "customer")
    k, book = F.col("c_custkey"), F.col("c_nationkey")
    word = F.when(k % 3 == 0, "One").when(k % 3 == 1, "Two").otherwise("Three")
    label = F.when(book % 6 != 0, F.concat(F.lit("Book "), word, F.lit(" / "), F.col("c_mktsegment"))).otherwise(F.lit(None))
    c = c.select(book.alias("book"), label.alias("source_label"), k.alias("start_page"), (k + 1).alias("end_page")).where("source_label IS NOT NULL")
    return ed.part_groups(c)


@query(f"WITH {ENTS} SELECT id AS place, src AS canonical_source, tgt AS canonical_target, CASE WHEN p_size % 2 = 0 THEN 'PERSON' ELSE 'LOCATION' END AS entity_type, array_to_string(aliases, '|') AS aliases, 'proposed' AS status FROM ents WHERE id % 9 <> 0")
def entity_csv(spark, sf):
    """Entities written as CSV and read again: rows without a name or of unknown types are refused, the others come back."""
    from ..operators.durable import new_path
    from ..sources import interchange as ix

    e, path = entities(spark, sf), new_path(spark, "entities")
    k = F.col("id")
    kind = F.when(k % 9 != 0, F.when(F.col("p_size") % 2 == 0, "PERSON").otherwise("LOCATION")).when(k % 2 == 0, "NO SUCH TYPE")
    ix.write_entity_csv(e.select("canonical_source", "canonical_target", kind.alias("entity_type"), "aliases", F.lit("proposed").alias("status"), k.cast("string").alias("notes")), path)
    good, _ = ix.read_entity_csv(spark, path)
    return good.select(F.col("notes").cast("long").alias("place"), "canonical_source", "canonical_target", "entity_type", F.array_join("aliases", "|").alias("aliases"), "status")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'unknown entity_type' ELSE 'entity_type is required' END AS error FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_partkey, 'canonical_source is required' FROM part WHERE p_partkey % 9 = 1 UNION ALL SELECT p_partkey, 'confidence out of range' FROM part WHERE p_partkey % 9 = 2")
def entity_csv_errors(spark, sf):
    """What is wrong with each refused row of an entity file."""
    from ..operators.durable import new_path
    from ..sources import interchange as ix

    e, path, k = entities(spark, sf), new_path(spark, "entities"), F.col("id")
    kind = F.when(k % 9 != 0, "PERSON").when(k % 2 == 0, "NO SUCH TYPE")
    name, sure = F.when(k % 9 != 1, F.col("canonical_source")), F.when(k % 9 == 2, "7").otherwise("0.5")
    ix.write_entity_csv(e.select(name.alias("canonical_source"), "canonical_target", kind.alias("entity_type"), "aliases", sure.alias("confidence"), k.cast("string").alias("notes")), path)
    _, bad = ix.read_entity_csv(spark, path)
    return bad.select(F.col("notes").cast("long").alias("id"), "error")


@query("SELECT p_partkey AS place, p_name AS source_term, p_type AS target_term, p_size % 2 = 0 AS preferred, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN lower(p_brand) ELSE 'un, \"due\"|' || lower(p_type) END AS forbidden, CASE WHEN p_size % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status FROM part")
def term_csv(spark, sf):
    """A termbase written as CSV, lists joined by bars, and read again."""
    from ..operators.durable import new_path
    from ..sources import interchange as ix

    k, path = F.col("p_size"), new_path(spark, "terms")
    bad = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lower("p_brand"))).otherwise(F.array(F.lit('un, "due"'), F.lower("p_type")))
    t_ = table(spark, sf, "part").select(F.col("p_name").alias("source_term"), F.col("p_type").alias("target_term"), F.lit("EVENT").alias("term_type"), (k % 2 == 0).alias("preferred"), bad.alias("forbidden_targets"), F.col("p_partkey").cast("string").alias("usage_notes"), F.when(k % 2 == 0, "approved").otherwise("proposed").alias("status"))
    ix.write_term_csv(t_, path)
    good, _ = ix.read_term_csv(spark, path)
    return good.select(F.col("usage_notes").cast("long").alias("place"), "source_term", "target_term", "preferred", F.array_join("forbidden_targets", "|").alias("forbidden"), "status")


@query(rf"""WITH {PAIRS}, b AS (SELECT conv_id, list(turn ORDER BY turn) AS want, list(turn ORDER BY turn) FILTER (conv_id % 4 <> 0 OR turn <> 1) AS got FROM bi GROUP BY conv_id),
i AS (SELECT conv_id, 0 AS place, 'cardinality' AS kind, CAST(NULL AS BIGINT) AS turn, 'hard' AS severity FROM b WHERE len(want) <> len(coalesce(got, [])) UNION ALL SELECT conv_id, 0, 'id_missing', CAST(unnest(list_filter(want, lambda x: NOT list_contains(coalesce(got, []), x))) AS BIGINT), 'hard' FROM b),
t AS (SELECT bi.*, target AS g FROM bi WHERE conv_id % 4 <> 0 OR turn <> 1),
k AS (SELECT conv_id, 1 AS place, 'internal_token' AS kind, CAST(turn AS BIGINT) AS turn, 'hard' AS severity FROM t WHERE len(list_distinct(regexp_extract_all(g, '\[\[[^\]]*\]\]'))) > 0
 UNION ALL SELECT conv_id, 3, 'forbidden_term', CAST(turn AS BIGINT), 'soft' FROM t WHERE source <> '' AND g <> '' AND contains(lower(g), 'idiot')
 UNION ALL SELECT conv_id, 3, 'must_keep', CAST(turn AS BIGINT), 'soft' FROM t WHERE source <> '' AND g <> '' AND NOT contains(lower(g), 'the'))
SELECT conv_id, place, kind, turn, severity, bool_or(severity = 'hard') OVER (PARTITION BY conv_id) AS discarded FROM (SELECT * FROM i UNION ALL SELECT * FROM k) WHERE kind IN ('cardinality', 'id_missing', 'internal_token', 'forbidden_term', 'must_keep')""")
def validation_suite(spark, sf):
    """Conversations as answers of a model, a turn lacking in every fourth: errors by place in the suite, and whether an answer is discarded.
    Of the checks of pairs those that the SQL states; the others have queries of their own."""
    from ..operators import validate as va

    p = pairs(spark, sf)
    got = F.when((F.col("conv_id") % 4 != 0) | (F.col("turn") != 1), F.col("turn").cast("long"))
    b = p.groupBy(F.col("conv_id").alias("batch")).agg(F.sort_array(F.collect_list(F.col("turn").cast("long"))).alias("want"), F.sort_array(F.collect_list(got)).alias("got"))
    answered = p.where((F.col("conv_id") % 4 != 0) | (F.col("turn") != 1)).select(F.col("conv_id").alias("batch"), F.col("turn").cast("long").alias("segment_id"), "source", "target")
    s = ed.validated(b, answered, ["idiot"], ["the"])
    s = s.where("kind IN ('cardinality', 'id_missing', 'internal_token', 'forbidden_term', 'must_keep')")
    return s.select(F.col("batch").alias("conv_id"), "place", "kind", F.col("segment_id").alias("turn"), "severity", F.max((F.col("severity") == va.HARD).cast("int")).over(_Window.partitionBy("batch")).cast("boolean").alias("discarded"))


@query(f"""WITH {UNITS}, c AS (SELECT *, CASE WHEN ordinal % 4 = 2 THEN CAST(ordinal * 5 AS INTEGER) END AS pos FROM units), x AS (SELECT *, coalesce(pos > 0 AND pos < len(source), false) AS cut FROM c),
m AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY chapter ORDER BY ordinal, segment_id) AS moves FROM x)
SELECT chapter, segment_id, CAST(ordinal + moves - CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS ordinal, CASE WHEN cut THEN substr(source, 1, pos) ELSE source END AS source FROM m
UNION ALL SELECT chapter, segment_id || '#2', CAST(ordinal + moves AS BIGINT), substr(source, pos + 1) FROM m WHERE cut""")
def segment_split(spark, sf):
    """Units cut by hand in two, each where the editor set the mark."""
    u = units(spark, sf).select("segment_id", "chapter", "ordinal", "source")
    return ed.split_units(u, u.where("ordinal % 4 = 2").select("segment_id", (F.col("ordinal") * 5).cast("int").alias("at")))


MERGES = "e AS (SELECT p_partkey AS entity, p_name AS name, p_size AS mentions, 1 AS version, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 3 END AS into_ FROM part)"


@query(f"WITH {MERGES} SELECT entity, name, mentions + coalesce((SELECT sum(x.mentions) FROM e x WHERE x.into_ = e.entity), 0) AS mentions, 1 + CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.into_ = e.entity) THEN 1 ELSE 0 END AS version FROM e WHERE into_ IS NULL")
def entity_merge(spark, sf):
    """Entities after every tenth was taken into another."""
    return _merged(spark, sf)[0]


@query(f"WITH {MERGES}, a AS (SELECT coalesce(into_, entity) AS entity, p_type AS alias FROM e JOIN part ON p_partkey = entity UNION ALL SELECT entity, upper(name) FROM e WHERE into_ IS NULL UNION ALL SELECT into_, upper(name) FROM e WHERE into_ IS NOT NULL UNION ALL SELECT into_, name FROM e WHERE into_ IS NOT NULL) SELECT entity, min(alias) AS alias FROM a GROUP BY entity, lower(alias)")
def entity_merge_aliases(spark, sf):
    return _merged(spark, sf)[1]


def _merged(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    e = p.select(k.alias("entity"), F.col("p_name").alias("name"), F.col("p_size").alias("mentions"), F.lit(1).alias("version"))
    a = p.select(k.alias("entity"), F.col("p_type").alias("alias")).union(p.select(k, F.upper("p_name")))
    return ed.merged_entities(e, a, p.where(k % 10 == 3).select(k.alias("entity"), (k - 3).alias("into")))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'BUILDING' ELSE c_mktsegment END AS status, 1 + CASE WHEN c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END AS version FROM customer")
def bulk_status(spark, sf):
    """Chosen rows set to one status; those that have it already keep their version."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    chosen = c.where("c_acctbal > 5000").select("id")
    return ed.with_status(c.select("id", F.col("c_mktsegment").alias("status"), F.lit(1).alias("version")), chosen.union(chosen), "BUILDING")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 30 MINUTES THEN 'failed' WHEN event_type = 'click' THEN 'running' ELSE event_type END AS status, event_type = 'click' AND ts < TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 30 MINUTES AS recovered FROM events")
def recover_jobs(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("beat"))
    return ed.recovered(e, F.lit("2024-01-10 12:00:00").cast("timestamp"), 30).drop("beat")
