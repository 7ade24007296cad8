"""Checks of a translated segment: columns (error or not) and rows of errors."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

HARD, SOFT = "hard", "soft"
#: fixed values: category of each kind of error
CATEGORY = {
    "cardinality": "omission", "id_missing": "omission", "id_extra": "addition", "id_order": "mistranslation", "placeholder": "grammar", "numbers": "wrong_term", "internal_token": "addition",
    "forbidden_term": "forbidden_term", "must_keep": "wrong_term", "entity": "wrong_term", "target_identical": "untranslated", "length": "omission", "merge": "mistranslation", "duplicate": "addition",
}
#: fixed values: limits
SHORT, LONG, IDENTICAL, RUN, OVERLAP = 0.25, 4.0, 0.95, 4, 0.45


def lost(source: Column, target: Column, *patterns: str) -> Column:
    """Distinct matches of the patterns in the source that the target lacks."""
    return F.filter(F.array_distinct(t.every(source, *patterns)), lambda x: ~target.contains(x))


def lost_numbers(source: Column, target: Column) -> Column:
    return lost(source, target, t.URL, t.ISO_DATE, t.SLASH_DATE, t.QUANTITY, t.NUMBER)


def lost_placeholders(source: Column, target: Column) -> Column:
    found = t.every(source, *t.PLACEHOLDERS)
    return F.filter(found, lambda x: ~target.contains(F.regexp_replace(x, "/$", "")))


def internal_tokens(target: Column) -> Column:
    return F.regexp_extract_all(target, F.lit(r"(?s)(\[\[.*?\]\])"), F.lit(1))


def present(target: Column, terms: Column) -> Column:
    """The terms that the target holds, case aside."""
    return F.filter(terms, lambda x: (x != "") & F.lower(target).contains(F.lower(x)))


def absent(target: Column, terms: Column) -> Column:
    return F.filter(terms, lambda x: (x != "") & ~F.lower(target).contains(F.lower(x)))


def length_error(source: Column, target: Column) -> Column:
    """short, long or null, by words."""
    a, b = F.size(t.words(source)), F.size(t.words(target))
    ratio = b / F.greatest(a, F.lit(1))
    return F.when(a > 0, F.when(ratio < SHORT, "short").when(ratio > LONG, "long"))


def compare_words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("([a-zà-ÿ0-9']+)"), F.lit(1))


def shared_run(s: Column, g: Column, size: int = RUN) -> Column:
    """Do two arrays of words share a run of that many?"""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - size + 1)
        return F.when(F.size(w) >= size, F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return F.arrays_overlap(grams(s), grams(g))


def with_leftover(pairs: DataFrame, name: str = "leftover") -> DataFrame:
    """pairs with: is a run of the source left in the target, and close to half of the target's words the source's?

    The words are columns of their own first, so that they are made once for each row.
    """
    w = pairs.withColumns({"_s": compare_words(F.col("source")), "_g": compare_words(F.col("target"))})
    s, g = F.col("_s"), F.col("_g")
    share = F.size(F.filter(g, lambda x: F.array_contains(s, x))) / F.greatest(F.size(g), F.lit(1))
    return w.withColumn(name, (share >= OVERLAP) & shared_run(s, g)).drop("_s", "_g")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by matching blocks, 0 to 1. Give it only pairs that could reach the threshold (see could_match)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def could_match(a: Column, b: Column, threshold: float) -> Column:
    """Upper bound by lengths: matching blocks can't be longer than the shorter text."""
    return 2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b))


def identical(pairs: DataFrame, threshold: float = IDENTICAL) -> DataFrame:
    """pairs (source, target and others) whose target is the source but for marks and case; short and numeric sources aside."""
    p = pairs.withColumns({"_a": t.for_compare("source"), "_b": t.for_compare("target")})
    p = p.where((F.col("_a") != "") & (F.col("_b") != "") & ~t.copy_allowed("source") & could_match(F.col("_a"), F.col("_b"), threshold))
    same = p.where(F.col("_a") == F.col("_b")).withColumn("ratio", F.lit(1.0))
    rest = p.where(F.col("_a") != F.col("_b")).withColumn("ratio", ratio("_a", "_b")).where(F.col("ratio") >= threshold)
    return same.unionByName(rest).drop("_a", "_b")


def errors(pairs: DataFrame, forbidden: list[str], keep: list[str]) -> DataFrame:
    """pairs (segment_id, source, target) -> rows (segment_id, kind, message, severity) of the checks of one segment."""
    s, g = F.col("source"), F.col("target")
    lists = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")

    def rows(found: Column, kind: str, severity: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("message"), F.lit(severity).alias("severity")))

    one = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(
        rows(internal_tokens(g), "internal_token", HARD), rows(lost_placeholders(s, g), "placeholder", SOFT), rows(lost_numbers(s, g), "numbers", SOFT),
        rows(present(g, lists(forbidden)), "forbidden_term", SOFT), rows(absent(g, lists(keep)), "must_keep", SOFT), rows(one(length_error(s, g)), "length", SOFT),
        rows(one(F.when(F.col("_leftover"), F.lit("run of the source"))), "leftover_english", HARD),
    )
    found = with_leftover(pairs.where((s != "") & (g != "")), "_leftover").select("segment_id", F.explode(all_).alias("e")).select("segment_id", "e.*")
    same = identical(pairs).select("segment_id", F.lit("target_identical").alias("kind"), F.lit("copy").alias("message"), F.lit(HARD).alias("severity"))
    return found.unionByName(same)


def issues(found: DataFrame) -> DataFrame:
    """errors() as issues: category and severity, each (segment, category, message) once."""
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[F.col("kind")], F.lit("wrong_term"))
    i = found.select("segment_id", category.alias("category"), F.when(F.col("severity") == HARD, "critical").otherwise("major").alias("severity"), F.col("message").alias("evidence"))
    return i.groupBy("segment_id", "category", "evidence").agg(F.min("severity").alias("severity"))


#: fixed values: words that don't count for length
STOPWORDS = "a an the and or but of to in on for with as is are was were be been being do does did has have had will would can could should i you he she it they we my your his her its not no yes any some each every other what which who that this there here all both more most few".split()
WORD = r"([A-Za-zÀ-ɏ]+|[0-9]+)"


def with_quality(pairs: DataFrame) -> DataFrame:
    """pairs with coverage, fluency (neutral without a parser), length_ok, variety and score.

    Tokens are columns of their own first, so that they are made once for each row.
    """
    source, target = F.col("source"), F.col("target")
    p = pairs.withColumns({"_inv": t.invariants(source), "_low": F.lower(target), "_a": F.greatest(F.size(F.regexp_extract_all(source, F.lit(WORD), F.lit(1))), F.lit(1)), "_w": F.transform(F.regexp_extract_all(target, F.lit(WORD), F.lit(1)), F.lower)})
    inv, low, w = F.col("_inv"), F.col("_low"), F.col("_w")
    p = p.withColumns({"_n": F.size(w), "_kept": F.size(F.filter(inv, lambda x: low.contains(F.lower(x)))), "_r": F.size(w) / F.col("_a")})
    n, r = F.col("_n"), F.col("_r")
    pairs_of = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    p = p.withColumns(
        {
            "coverage": F.when(F.size(inv) == 0, 1.0).otherwise(F.col("_kept") / F.greatest(F.size(inv), F.lit(1))),
            "fluency": F.lit(0.5),
            "length_ok": F.when((r >= 0.55) & (r <= 1.95), 1.0).when(r < 0.55, F.greatest(F.lit(0.0), 1 - (0.55 - r) / 0.55)).otherwise(F.greatest(F.lit(0.0), 1 - (r - 1.95) / 1.95)),
            "variety": F.when(n <= 2, 0.5).otherwise(0.5 * F.size(F.array_distinct(w)) / n + 0.5 * F.size(F.array_distinct(pairs_of)) / F.greatest(n - 1, F.lit(1))),
        }
    )
    score = 0.45 * F.col("coverage") + 0.30 * F.col("fluency") + 0.15 * F.col("length_ok") + 0.10 * F.col("variety")
    return p.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).drop("_inv", "_low", "_a", "_w", "_n", "_kept", "_r")


def entity_errors(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(segment_id, canonical_source, policy) where a source names an entity as a word and the target lacks what its
    policy asks for: the source's form where it isn't translated, else the target's; inflected if that is allowed.

    entities(canonical_source, canonical_target, policy, allow_inflection) is a stated list, held against all pairs.
    """
    from .termbase import bounded, word_pattern

    low = F.lower("source")
    named = F.regexp_like(low, word_pattern(F.lower("canonical_source"), False))
    as_is = F.lower("policy").isin("not_translate", "block_batch")
    wanted = F.lower(F.when(as_is, F.col("canonical_source")).otherwise(F.col("canonical_target")))
    exact, inflected = (F.regexp_like(F.lower("target"), word_pattern(wanted, x)) for x in (False, True))
    there = F.when(F.col("allow_inflection"), inflected).otherwise(exact)
    both = pairs.where("source <> '' AND target <> ''").join(bounded(entities.where("canonical_source <> ''")), F.lit(True)).where(named)
    return both.where((as_is | (F.coalesce("canonical_target", F.lit("")) != "")) & ~there).select("segment_id", "canonical_source", "policy")


def is_copy(source: Column, target: Column) -> Column:
    """The target is the source but for marks and case, and that isn't allowed."""
    return (t.for_compare(source) == t.for_compare(target)) & ~t.copy_allowed(source)


def untranslated(source: Column, target: Column, lang: str, probability: Column, limit: float = 0.5) -> Column:
    """No mark of the language in the target, and a verifier's probability under the limit; short and numeric sources aside."""
    return ~t.copy_allowed(source) & ~t.has_markers(target, lang) & (F.coalesce(probability, F.lit(0.0)) < limit)
