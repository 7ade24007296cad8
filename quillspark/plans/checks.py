"""Queries over checks of translated segments. Adjacent turns stand in for source and target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import validate as va
from ..session import table
from .memory import PAIRS, pairs

KEYS = "conv_id, turn"
WORDS = "list_filter(string_split(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _cols(df, **cols):
    return df.select("conv_id", "turn", *[v.alias(k) for k, v in cols.items()])




def _s():
    return F.col("source"), F.col("target")


NUMBERS = r"list_distinct(list_concat(list_concat(regexp_extract_all(source, '(?i)https?://[^\s]+'), regexp_extract_all(source, '\b\d{4}-\d{2}-\d{2}\b')), list_concat(regexp_extract_all(source, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'), regexp_extract_all(source, '\b\d+(?:[.,]\d+)?\b'))))"


@query(f"WITH {PAIRS} SELECT {KEYS}, len(list_filter({NUMBERS}, lambda x: NOT contains(target, x))) AS lost FROM bi")
def val_numbers(spark, sf):
    from ..functions import text as t

    s, g = _s()
    return _cols(pairs(spark, sf), lost=F.size(va.lost(s, g, t.URL, t.ISO_DATE, t.SLASH_DATE, t.NUMBER)).cast("long"))


@query(rf"WITH {PAIRS} SELECT {KEYS}, len(list_filter(list_concat(list_concat(regexp_extract_all(source, '\{{[^}}]+\}}'), regexp_extract_all(source, '<[^/>\s]+(?:\s[^/>]*[^/])?/?>')), regexp_extract_all(source, '\$\{{[^}}\+]+\}}')), lambda x: NOT contains(target, x))) AS lost FROM bi")
def val_placeholders(spark, sf):
    return _cols(pairs(spark, sf), lost=F.size(va.lost_placeholders(*_s())).cast("long"))


@query(rf"WITH {PAIRS} SELECT {KEYS}, len(regexp_extract_all(target, '(?s)\[\[.*?\]\]')) AS tokens FROM bi")
def val_tokens(spark, sf):
    return _cols(pairs(spark, sf), tokens=F.size(va.internal_tokens(F.col("target"))).cast("long"))


TERMS = ["the", "Thing", "idiot", "", "que"]
LIST = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"


@query(f"WITH {PAIRS} SELECT {KEYS}, len(list_filter({LIST}, lambda x: x <> '' AND contains(lower(target), lower(x)))) AS found FROM bi")
def val_forbidden(spark, sf):
    return _cols(pairs(spark, sf), found=F.size(va.present(F.col("target"), F.array(*map(F.lit, TERMS)))).cast("long"))


@query(f"WITH {PAIRS} SELECT {KEYS}, len(list_filter({LIST}, lambda x: x <> '' AND NOT contains(lower(target), lower(x)))) AS missing FROM bi")
def val_mustkeep(spark, sf):
    return _cols(pairs(spark, sf), missing=F.size(va.absent(F.col("target"), F.array(*map(F.lit, TERMS)))).cast("long"))


@query(f"WITH {PAIRS}, n AS (SELECT {KEYS}, len({WORDS.format(x='source')}) AS a, len({WORDS.format(x='target')}) AS b FROM bi) SELECT {KEYS}, CASE WHEN a = 0 THEN NULL WHEN b / a < 0.25 THEN 'short' WHEN b / a > 4.0 THEN 'long' END AS problem FROM n")
def val_length(spark, sf):
    return _cols(pairs(spark, sf), problem=va.length_error(*_s()))


@query(f"WITH {PAIRS} SELECT conv_id, trim(target) AS target, count(*) AS n FROM bi WHERE trim(target) <> '' GROUP BY conv_id, trim(target) HAVING count(*) > 1")
def val_merge(spark, sf):
    return pairs(spark, sf).groupBy("conv_id", F.trim("target").alias("target")).agg(F.count("*").alias("n")).where("n > 1 AND target <> ''")


CW = "regexp_extract_all(lower({x}), '[a-zà-ÿ0-9'']+')"
G4 = "CASE WHEN len({w}) >= 4 THEN list_transform(range(1, len({w}) - 2), lambda i: array_to_string({w}[i:i+3], ' ')) ELSE [] END"


@query(f"""WITH {PAIRS}, w AS (SELECT {KEYS}, {CW.format(x='source')} AS s, {CW.format(x='target')} AS g FROM bi)
SELECT {KEYS}, len(list_intersect({G4.format(w='s')}, {G4.format(w='g')})) > 0 AND len(list_filter(g, lambda x: list_contains(s, x))) / greatest(1, len(g)) >= 0.45 AS leftover FROM w""")
def val_leftover(spark, sf):
    return va.with_leftover(pairs(spark, sf)).select("conv_id", "turn", "leftover")


@query()
def val_identical(spark, sf):
    """Turns that are copies of the one before: the similarity of those that reach the limit."""
    return va.identical(pairs(spark, sf)).select("conv_id", "turn", F.round("ratio", 4).alias("ratio"))


@query()
def qa_issues(spark, sf):
    """Issues of all checks over adjacent turns."""
    p = pairs(spark, sf).withColumn("segment_id", F.concat_ws(":", "conv_id", "turn"))
    return va.issues(va.errors(p, ["idiot"], ["the"]))


W = "regexp_extract_all({x}, '[A-Za-zÀ-ɏ]+|[0-9]+')"


@query(rf"""WITH {PAIRS}, w AS (SELECT {KEYS}, list_concat(list_concat(regexp_extract_all(source, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), regexp_extract_all(source, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b')), list_concat(regexp_extract_all(source, '(?i)https?://[^\s]+'), regexp_extract_all(source, '\b\d+(?:[.,]\d+)?\b'))) AS inv, target,
  greatest(1, len({W.format(x='source')})) AS a, list_transform({W.format(x='target')}, lambda x: lower(x)) AS g FROM bi),
q AS (SELECT {KEYS}, CASE WHEN len(inv) = 0 THEN 1.0 ELSE len(list_filter(inv, lambda x: contains(lower(target), lower(x)))) / len(inv) END AS coverage,
  CASE WHEN len(g) / a BETWEEN 0.55 AND 1.95 THEN 1.0 WHEN len(g) / a < 0.55 THEN greatest(0.0, 1 - (0.55 - len(g) / a) / 0.55) ELSE greatest(0.0, 1 - (len(g) / a - 1.95) / 1.95) END AS length_ok,
  CASE WHEN len(g) <= 2 THEN 0.5 ELSE 0.5 * len(list_distinct(g)) / len(g) + 0.5 * len(list_distinct(list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1]))) / (len(g) - 1) END AS variety FROM w)
SELECT {KEYS}, round(CAST(coverage AS DOUBLE) + 1e-9, 4) AS coverage, round(CAST(length_ok AS DOUBLE) + 1e-9, 4) AS length_ok, round(CAST(variety AS DOUBLE) + 1e-9, 4) AS variety, round(CAST(0.45 * coverage + 0.15 + 0.15 * length_ok + 0.10 * variety AS DOUBLE) + 1e-9, 4) AS score FROM q""")
def qe_scores(spark, sf):
    q = va.with_quality(pairs(spark, sf))
    return q.select("conv_id", "turn", *[F.round(F.col(k) + 1e-9, 4).alias(k) for k in ("coverage", "length_ok", "variety", "score")])


#: entities of the stand-ins: source, target, policy, inflection allowed
ENTITIES = [("the", "that", "translate", False), ("thing", "stone", "not_translate", True), ("you", "", "translate", False), ("and", "for", "translate", True)]
ENTITIES_SQL = "ents(s, g, policy, inflect) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()})" for a, b, c, d in ENTITIES) + ")"
_W = r"'(^|[^\p{L}\p{N}_])' || {x} || '([^\p{L}\p{N}_]|$)'"
_STEM = r"'(^|[^\p{L}\p{N}_])' || CASE WHEN len({x}) > 3 AND {x}[-1] IN ('a', 'e', 'i', 'o', 'u') THEN {x}[:-2] ELSE {x} END"
_WANT = "CASE WHEN policy = 'not_translate' THEN s ELSE g END"


@query(f"""WITH {PAIRS}, {ENTITIES_SQL} SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS segment_id, s AS canonical_source, policy FROM bi, ents
WHERE source <> '' AND target <> '' AND regexp_matches(lower(source), {_W.replace('{x}', 's')}) AND (policy = 'not_translate' OR g <> '')
 AND NOT CASE WHEN inflect THEN regexp_matches(lower(target), {_STEM.replace('{x}', '(' + _WANT + ')')}) ELSE regexp_matches(lower(target), {_W.replace('{x}', '(' + _WANT + ')')}) END""")
def val_entities(spark, sf):
    e = spark.createDataFrame(ENTITIES, "canonical_source string, canonical_target string, policy string, allow_inflection boolean")
    p = pairs(spark, sf).withColumn("segment_id", F.concat_ws(":", "conv_id", "turn"))
    return va.entity_errors(p, e)


_NORM = r"trim(regexp_replace(lower(replace(replace(replace(translate({x}, '“”„«»‘’', '\"\"\"\"\"'''''), '—', '--'), '–', '-'), '…', '...')), '[ \t\n\r]+', ' ', 'g'))".replace('\\"', '"')


@query(f"""WITH d AS (SELECT source, text, lower(text) AS low, min(doc_id) AS doc_id FROM documents GROUP BY source, text) SELECT doc_id, {_NORM.format(x='text')} = {_NORM.format(x='low')} AND len(regexp_extract_all({_NORM.format(x='text')}, '[^ ]+')) >= 4
 AND NOT (len(regexp_extract_all({_NORM.format(x='text')}, '\\p{{N}}')) > 0 AND len(regexp_extract_all({_NORM.format(x='text')}, '\\p{{N}}')) / greatest(1, len(regexp_extract_all({_NORM.format(x='text')}, '\\p{{L}}')) + len(regexp_extract_all({_NORM.format(x='text')}, '\\p{{N}}'))) > 0.3) AS copy FROM d""")
def copy_check(spark, sf):
    """A text and its lower case are a copy, unless it may be."""
    d = table(spark, sf, "documents").groupBy("source", "text").agg(F.min("doc_id").alias("doc_id"))
    return d.select("doc_id", va.is_copy(F.col("text"), F.lower("text")).alias("copy"))


@query()
def untranslated_gate(spark, sf):
    """Documents without marks of German that a verifier doubts as well."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.where(va.untranslated(F.col("text"), F.col("text"), "de", F.col("quality") * 0.6)).select("doc_id", "lang")


@query("SELECT a.s_suppkey, NOT (lower(n.n_name) <> lower(r.r_name)) AS fits FROM supplier a JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def context_fit(spark, sf):
    from ..operators import memory as tm

    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select("s_suppkey", tm.fits_context(F.col("n_name"), F.lit(None).cast("string"), F.col("r_name"), F.lit("first")).alias("fits"))
