"""The operators' queries over whole tables, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, htmltext, ngrams, quality, simhash, substrings, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffixes.digests(_table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op3_warc(spark, sf_dir):
    return warc.digests(_table(spark, sf_dir, "pages"))


ORACLES["op3_warc"] = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), c AS (
  SELECT payload_digest, max(page_id) AS chosen FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN chosen IS NULL OR page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN chosen IS NOT NULL AND page_id <> chosen THEN chosen END AS refers_to
FROM p LEFT JOIN c ON p.payload_digest = c.payload_digest
"""


@query
def op4_ngram_scores(spark, sf_dir):
    return ngrams.scored(_table(spark, sf_dir, "documents"))


@query
def op5_simhash_dedup(spark, sf_dir):
    return simhash.digests(_table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark, sf_dir):
    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op6_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM bi),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
m AS (SELECT doc_id, i, p.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS key FROM di) x JOIN p ON x.k = p.k AND x.key = p.key),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op8_substring_dedup(spark, sf_dir):
    return substrings.digests(_table(spark, sf_dir, "documents"))


ORACLES["op8_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT run, min(doc_id) AS least FROM r GROUP BY run),
g AS (SELECT DISTINCT doc_id, i + j AS n FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM r JOIN f USING (run) WHERE least < doc_id)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM d),
k AS (SELECT x.doc_id, count(g.n) AS n_removed, string_agg(word, ' ' ORDER BY x.n) FILTER (g.n IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.n = g.n GROUP BY x.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op9_html_text(spark, sf_dir):
    return htmltext.digests(_table(spark, sf_dir, "pages"))


@query
def op10_quality_rules(spark, sf_dir):
    return quality.rules(_table(spark, sf_dir, "documents"))
