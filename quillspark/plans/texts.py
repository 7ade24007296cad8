"""Queries over scalar text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as t
from ..operators import lines as ln
from ..session import table

#: SQL for the documents' lines, and for their sentences
LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
SENTENCES = r"""sents AS (
  SELECT doc_id, source, lang, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
    SELECT doc_id, source, lang, unnest(list_transform(string_split(regexp_replace(text, '([.!?…])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'))) AS s,
           generate_subscripts(string_split(regexp_replace(text, '([.!?…])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), 1) AS i
    FROM documents) WHERE s <> '')"""
TOKENS = r"CAST(coalesce(list_sum(list_transform(regexp_extract_all({x}, '[ \t\n\r]+|[^ \t\n\r\p{{L}}\p{{N}}_]+|[\p{{L}}\p{{N}}_]+'), lambda w: greatest(1, (len(w) + 2) // 3))), 0) AS BIGINT)"


@query(f"""WITH {SENTENCES}
SELECT lang, count(*) AS segments, CAST(sum(len(s)) AS BIGINT) AS chars, CAST(sum({TOKENS.format(x="s")}) AS BIGINT) AS tokens FROM sents GROUP BY lang""")
def segment_stats(spark, sf):
    s = ln.sentences(table(spark, sf, "documents"))
    return s.groupBy("lang").agg(F.count("*").alias("segments"), F.sum(F.length("sentence").cast("long")).alias("chars"), F.sum(t.estimated_tokens("sentence")).alias("tokens"))


@query(f"WITH {SENTENCES} SELECT doc_id, n AS ordinal, s AS sentence, sha256(s) AS source_hash FROM sents")
def seg_sentences(spark, sf):
    s = ln.sentences(table(spark, sf, "documents"))
    return s.select("doc_id", "ordinal", "sentence", F.sha2("sentence", 256).alias("source_hash"))


@query(f"SELECT doc_id, {TOKENS.format(x='text')} AS tokens, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS words FROM documents")
def seg_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", t.estimated_tokens("text").alias("tokens"), F.size(t.words("text")).cast("long").alias("words"))


@query(rf"""WITH {LINES}, k AS (
  SELECT lang, CASE
    WHEN trim(line) = '' THEN 'paragraph'
    WHEN regexp_matches(trim(line), '^[*#•.\s~\-—–]{{3,}}$') THEN 'scene_break'
    WHEN regexp_matches(trim(line), '(?i)^[“"'']?(An old |Ancient |Old )?(saying|proverb|epigraph)([^\p{{L}}\p{{N}}_]|$)') THEN 'epigraph'
    WHEN regexp_matches(trim(line), '^(Dear|My dear|Dearest|Darling|My own)\s+[A-Z]') OR regexp_matches(trim(line), '(Yours|Sincerely|Farewell|Ever yours|With love)[,\s]') THEN 'letter'
    WHEN trim(line)[1] IN ('“', '"', '«', '‘', '’', '”', '''', '—', '–') THEN 'dialogue'
    WHEN starts_with(trim(line), '> ') THEN 'quotation' ELSE 'paragraph' END AS kind
  FROM lines)
SELECT lang, kind, count(*) AS n FROM k GROUP BY lang, kind""")
def seg_kind_counts(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    return lines.groupBy("lang", t.paragraph_kind("line").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH ns AS (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('quillspark:segment:v1')) AS h0),
n1 AS (SELECT substr(h0,1,12) || '5' || substr(h0,14,3) || format('{{:x}}', (CAST('0x' || substr(h0,17,1) AS INTEGER) & 3) | 8) || substr(h0,18,15) AS ns FROM ns),
{LINES}, h AS (SELECT doc_id, line_no, sha1(unhex(ns) || encode(source || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR))) AS h FROM lines, n1)
SELECT doc_id, CAST(line_no AS BIGINT) AS ordinal, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || format('{{:x}}', (CAST('0x' || substr(h,17,1) AS INTEGER) & 3) | 8) || substr(h,18,3) || '-' || substr(h,21,12) AS segment_id FROM h""")
def seg_uuid5(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    return lines.select("doc_id", F.col("line_no").alias("ordinal"), ln.segment_id("source", "doc_id", "line_no").alias("segment_id"))


@query(rf"""WITH {LINES}, k AS (SELECT trim(regexp_replace(regexp_replace(line, '\d', '#', 'g'), '[ \t\x{{00a0}}]+', ' ', 'g')) AS line_key, doc_id FROM lines)
SELECT line_key, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM k WHERE line_key <> '' GROUP BY line_key HAVING count(*) > 1""")
def line_keys(spark, sf):
    lines = ln.lines(table(spark, sf, "documents")).select("doc_id", t.line_key("line").alias("line_key")).where("line_key <> ''")
    return lines.groupBy("line_key").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("docs")).where("occurrences > 1")


@query(rf"""WITH {SENTENCES} SELECT doc_id, (n - 1) // 3 AS block, string_agg(s, ' ' ORDER BY n) AS text, count(*) AS parts FROM sents GROUP BY doc_id, (n - 1) // 3""")
def merge_n_sentences(spark, sf):
    s = ln.sentences(table(spark, sf, "documents")).withColumn("block", F.floor((F.col("ordinal") - 1) / 3))
    g = s.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(F.struct("ordinal", "sentence"))).alias("s"))
    return g.select("doc_id", "block", F.array_join(F.col("s.sentence"), " ").alias("text"), F.size("s").cast("long").alias("parts"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '^(the|a|an)\s+', ''), '''s\s*$', ''), '[^0-9a-zÀ-ɏ]+', ' ', 'g'), '\s+', ' ', 'g')) AS name_key FROM part""")
def norm_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.name_key("p_name").alias("name_key"))


NORMAL = r"trim(regexp_replace(lower(replace(replace(replace(translate({x}, '“”„«»‘’', '\"\"\"\"\"'''''), '—', '--'), '–', '-'), '…', '...')), '[ \t\n\r]+', ' ', 'g'))".replace('\\"', '"')


@query(rf"""WITH k AS (SELECT {NORMAL.format(x="text")} AS k FROM documents)
SELECT k AS normalised, count(*) AS n FROM k GROUP BY k HAVING count(*) > 1""")
def cmp_normalise(spark, sf):
    d = table(spark, sf, "documents").groupBy(t.for_compare("text").alias("normalised")).agg(F.count("*").alias("n"))
    return d.where("n > 1")


@query(rf"""WITH {LINES}, k AS (SELECT lang, {NORMAL.format(x="line")} AS a FROM lines)
SELECT lang, count(*) FILTER (a = '' OR len(regexp_extract_all(a, '[^ ]+')) < 4
   OR (len(regexp_extract_all(a, '\p{{N}}')) > 0 AND len(regexp_extract_all(a, '\p{{N}}')) / greatest(1, len(regexp_extract_all(a, '\p{{L}}')) + len(regexp_extract_all(a, '\p{{N}}'))) > 0.3)) AS exempt,
  count(*) AS lines FROM k GROUP BY lang""")
def copy_exempt(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    return lines.groupBy("lang").agg(F.count_if(t.copy_allowed("line")).alias("exempt"), F.count("*").alias("lines"))


def _markers_sql(lang: str) -> str:
    frequent, plain, letters = t.MARKERS[lang]
    padded = "regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
    quoted = frequent.replace("'", "''")
    n = f"len(regexp_extract_all({padded}, '(^|[^\\p{{L}}\\p{{N}}_])({quoted})([^\\p{{L}}\\p{{N}}_]|$)'))"
    if plain:
        n += f" + len(regexp_extract_all({padded.replace('lower(text)', 'text')}, '(^|[^\\p{{L}}\\p{{N}}_])({plain})([^\\p{{L}}\\p{{N}}_]|$)'))"
    return f"(regexp_matches(text, '[{letters}]') OR {n} >= 2)"


@query("SELECT lang, " + ", ".join(f"count(*) FILTER ({_markers_sql(x)}) AS as_{x}" for x in ("it", "es", "de", "pt")) + ", count(*) AS docs FROM documents GROUP BY lang")
def lang_markers(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("lang").agg(*[F.count_if(t.has_markers("text", x)).alias(f"as_{x}") for x in ("it", "es", "de", "pt")], F.count("*").alias("docs"))


@query("SELECT CAST(sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS BIGINT) AS german, count(*) FILTER (lang = 'de' AND m) AS found, count(*) FILTER (lang <> 'de' AND m) AS wrong FROM (SELECT lang, " + _markers_sql("de") + " AS m FROM documents)")
def lang_marker_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("lang", t.has_markers("text", "de").alias("m"))
    return d.agg(F.count_if(F.col("lang") == "de").alias("german"), F.count_if((F.col("lang") == "de") & F.col("m")).alias("found"), F.count_if((F.col("lang") != "de") & F.col("m")).alias("wrong"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS t FROM documents),
q AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, '.'), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda x: x <> '') AS parts FROM p)
SELECT doc_id, CASE WHEN len(parts) < 2 THEN t ELSE parts[1] || '. ' || parts[-1] || CASE WHEN ends_with(t, '.') THEN '.' ELSE '' END END AS excerpt FROM q""")
def head_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.head_tail("text").alias("excerpt"))


@query("""SELECT conv_id, turn, translate(text, '“”„«»‘’', '\"\"\"\"\"''''') AS plain, len(regexp_extract_all(text, '[“”„«»‘’]')) AS changed FROM conversations""")
def quotes_ascii(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", t.plain_quotes("text").alias("plain"), F.regexp_count("text", F.lit("[“”„«»‘’]")).cast("long").alias("changed"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)https?://[^\s]+')) AS urls, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS emails,
  len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)*')) AS numbers FROM documents""")
def placeholder_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("long").alias(n) for n, p in (("urls", t.URL), ("emails", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), ("numbers", r"[0-9]+([.,][0-9]+)*"))])


@query(r"""SELECT page_id, len(regexp_extract_all(x, '[(\[{«]')) - len(regexp_extract_all(x, '[)\]}»]')) AS depth FROM (SELECT page_id, regexp_replace(html, '(?s)\\.', '', 'g') AS x FROM pages)""")
def bracket_balance(spark, sf):
    return table(spark, sf, "pages").select("page_id", t.bracket_balance("html").alias("depth"))


@query("SELECT doc_id, " + ", ".join(f"len(text) - len(replace(text, '{m}', '')) AS {n}" for n, m in (("hyphens", "-"), ("dashes", "—"), ("ellipses", "…"), ("quotes", '"'), ("stops", "."))) + " FROM documents")
def preserve_report(spark, sf):
    d = table(spark, sf, "documents")
    marks = (("hyphens", "-"), ("dashes", "—"), ("ellipses", "…"), ("quotes", '"'), ("stops", "."))
    return d.select("doc_id", *[(F.length("text") - F.length(F.replace("text", F.lit(m)))).cast("long").alias(n) for n, m in marks])


@query(rf"""WITH {LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
  round(CASE WHEN len(regexp_extract_all(line, '\p{{L}}')) = 0 THEN 0.0 ELSE len(regexp_extract_all(line, '\p{{Lu}}')) / len(regexp_extract_all(line, '\p{{L}}')) END, 6) AS upper_ratio,
  len(list_filter(string_split(trim(regexp_replace(line, '[ \t]+', ' ', 'g')), ' '), lambda w: regexp_matches(trim(lower(w), '.,:;()'), '^[ivxlcdm]+$'))) > 0 AS roman,
  len(list_filter(string_split(trim(regexp_replace(line, '[ \t]+', ' ', 'g')), ' '), lambda w: trim(lower(w), '.,:;!?"''()') IN ('chapter', 'part', 'book', 'prologue', 'epilogue', 'interlude', 'foreword', 'preface', 'afterword'))) > 0 AS structural
FROM lines""")
def heading_words(spark, sf):
    lines = ln.lines(table(spark, sf, "documents"))
    return lines.select("doc_id", "line_no", F.round(t.upper_ratio("line"), 6).alias("upper_ratio"), t.has_roman("line").alias("roman"), t.is_structural("line").alias("structural"))


@query(r"""SELECT p_partkey, CASE WHEN strpos(x, ' ') = 0 THEN upper(x[1]) || lower(x[2:]) ELSE upper(x[1]) || lower(x[2:strpos(x, ' ') - 1]) || substr(x, strpos(x, ' ')) END AS title,
 CASE WHEN starts_with(lower(x), 'epilogue') OR starts_with(lower(x), 'afterword') THEN 'back_matter' WHEN starts_with(lower(x), 'part') OR starts_with(lower(x), 'book') THEN 'part' ELSE 'chapter' END AS kind
FROM (SELECT p_partkey, trim(regexp_replace(p_name, '[ \t]+', ' ', 'g')) AS x FROM part)""")
def normal_titles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.normal_title("p_name").alias("title"), t.node_kind("p_name").alias("kind"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^(localhost|127\.0\.0\.1|0\.0\.0\.0)$|\.local$') AS is_local FROM pages")
def url_host(spark, sf):
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), (host.isin("localhost", "127.0.0.1", "0.0.0.0") | host.endswith(".local")).alias("is_local"))


@query(r"""SELECT page_id, CASE WHEN len(x) > 400 THEN rtrim(x[1:400], ' ') || '…' ELSE x END AS excerpt, len(x) AS chars FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS x FROM pages)""")
def page_excerpt(spark, sf):
    x = t.collapse(F.regexp_replace("html", "<[^>]+>", ""))
    p = table(spark, sf, "pages").select("page_id", x.alias("x"))
    return p.select("page_id", F.when(F.length("x") > 400, F.concat(F.rtrim(F.substring("x", 1, 400)), F.lit("…"))).otherwise(F.col("x")).alias("excerpt"), F.length("x").cast("long").alias("chars"))


@query(r"""WITH r AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, '(?i)<(b|i|em|strong)>', chr(1) || '+', 'g'), '(?i)</(b|i|em|strong)>|<br>', chr(1) || '-', 'g'), chr(1))) AS run FROM pages)
SELECT page_id, count(*) FILTER (starts_with(run, '+')) AS marked, CAST(coalesce(sum(len(run) - 1) FILTER (starts_with(run, '+')), 0) AS BIGINT) AS chars FROM r GROUP BY page_id""")
def italic_runs(spark, sf):
    marked = F.regexp_replace(F.regexp_replace("html", "(?i)<(b|i|em|strong)>", "\x01+"), "(?i)</(b|i|em|strong)>|<br>", "\x01-")
    r = table(spark, sf, "pages").select("page_id", F.explode(F.split(marked, "\x01")).alias("run"))
    on = F.col("run").startswith("+")
    return r.groupBy("page_id").agg(F.count_if(on).alias("marked"), F.coalesce(F.sum(F.when(on, F.length("run").cast("long") - 1)), F.lit(0)).alias("chars"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\[\[[A-Z_]+:[^\]]*\]\]')) AS control_tokens, regexp_replace(text, '\[\[[A-Z_]+:[^\]]*\]\]', '', 'g') = text AS clean FROM documents""")
def control_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(t.control_tokens("text")).cast("long").alias("control_tokens"), (F.regexp_replace("text", r"\[\[[A-Z_]+:[^\]]*\]\]", "") == F.col("text")).alias("clean"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(lower(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, len(list_filter(w, lambda x: x = 'i')) AS isolated, len(w) > 0 AND len(list_filter(w, lambda x: x NOT IN ('i', 'me', 'my', 'myself', 'we', 'us', 'our', 'ours', 'you', 'your', 'yours', 'yourself'))) = 0 AS personal FROM w""")
def pronoun_surfaces(spark, sf):
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", F.size(F.filter(t.words(F.lower("text")), lambda x: x == "i")).cast("long").alias("isolated"), t.personal_only("text").alias("personal"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'))) AS iso_dates, len(list_distinct(regexp_extract_all(text, '\b\d{1,2}/\d{1,2}/\d{2,4}\b'))) AS slash_dates FROM documents""")
def dates(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(F.array_distinct(t.every("text", t.ISO_DATE))).cast("long").alias("iso_dates"), F.size(F.array_distinct(t.every("text", t.SLASH_DATE))).cast("long").alias("slash_dates"))


@query("""SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(text) AS sha, '{"redacted":true,"len":' || len(text) || ',"sha256":"' || sha256(text) || '"}' AS stub FROM documents""")
def redact(spark, sf):
    d = table(spark, sf, "documents")
    stub = F.to_json(F.struct(F.lit(True).alias("redacted"), F.length("text").alias("len"), F.sha2("text", 256).alias("sha256")))
    return d.select("doc_id", F.col("n_chars").cast("long"), F.sha2("text", 256).alias("sha"), stub.alias("stub"))


@query(r"""SELECT DISTINCT p_size, lower(p_brand) AS name, TRY_CAST(regexp_extract(p_size || 'k', '^(\d+)k$', 1) AS BIGINT) * 1024 AS tokens FROM part""")
def context_hints(spark, sf):
    p = table(spark, sf, "part").select("p_size", F.lower("p_brand").alias("name")).distinct()
    return p.select("p_size", "name", t.context_window(F.concat_ws(" ", F.lit("model"), F.concat(F.col("p_size").cast("string"), F.lit("K")))).alias("tokens"))


@query(f"""WITH {LINES} SELECT doc_id, regexp_replace(string_agg(line, ' ' ORDER BY line_no), '- ', '-', 'g') AS text FROM lines WHERE NOT regexp_matches(line, '- ') AND line <> '' GROUP BY doc_id""")
def assembled_lines(spark, sf):
    lines = ln.lines(table(spark, sf, "documents")).where(~F.col("line").contains("- ") & (F.col("line") != ""))
    g = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return g.select("doc_id", t.assembled(F.col("l.line")).alias("text"))
