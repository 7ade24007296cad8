"""Terms: validation, mentions in texts, selection for a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: fixed values: what the fields may hold
TYPES = ("PERSON", "ROLE", "CREATURE_SPECIES", "OBJECT_ARTIFACT", "LOCATION", "ORG_FACTION", "WORK_MEDIA", "EVENT", "CONCEPT_TERM", "TITLE_HONORIFIC")
GENDERS = ("masculine", "feminine", "neuter", "common", "variable", "not_applicable")
NUMBERS = ("singular", "plural", "invariant", "collective", "unknown")
STATUSES = ("proposed", "verified", "approved", "deprecated", "archived")
TRUE = ("1", "true", "yes", "y", "t", "preferred", "preferito")
FALSE = ("0", "false", "no", "n", "f", "", "not", "vietato")
#: fixed values: most terms and entities for a block
MAX_TERMS, MAX_ENTITIES = 20, 30


def _clean(col: str, up: bool = False) -> Column:
    x = t.strip(F.coalesce(F.col(col).cast("string"), F.lit("")))
    return F.upper(x) if up else F.lower(x)


def as_boolean(col: str) -> Column:
    """Null for what is neither a yes nor a no."""
    x = _clean(col)
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False)


def as_list(col: str, separator: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), separator), t.strip), lambda x: x != "")


def row_error() -> Column:
    """The first thing wrong with a term's row, null if nothing is."""
    gender, number, status = _clean("grammatical_gender_target"), _clean("grammatical_number"), _clean("status")
    return (
        F.when(_clean("source_term") == "", "source_term is required")
        .when(_clean("term_type") == "", "term_type is required")
        .when(~_clean("term_type", True).isin(*TYPES), "unknown term_type")
        .when(as_boolean("preferred").isNull(), "invalid boolean")
        .when((gender != "") & ~gender.isin(*GENDERS), "invalid gender")
        .when((number != "") & ~number.isin(*NUMBERS), "invalid number")
        .when((status != "") & ~status.isin(*STATUSES), "unknown status")
    )


def bounded(terms: DataFrame) -> DataFrame:
    """Terms as a broadcast side only as long as they are few; beyond that the join is dealt by the planner."""
    limit = 100_000
    return F.broadcast(terms) if terms.limit(limit + 1).count() <= limit else terms


def word_pattern(word: Column, stem: bool) -> Column:
    """Pattern of a word, or of what begins with its stem (the word without a final vowel, if it is longer than three)."""
    if stem:
        word = F.when((F.length(word) > 3) & F.substr(word, F.lit(-1)).isin(*"aeiou"), F.left(word, F.length(word) - 1)).otherwise(word)
    quoted = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit("" if stem else r"(?![\p{L}\p{N}_])"))


def mentions(texts: DataFrame, terms: DataFrame, ident: str) -> DataFrame:
    """(ident, source_term, inside, as_word, as_stem) of every text and term: is it a substring, a word, the beginning of one?"""
    low, term = F.lower(F.col("text")), F.lower(F.col("source_term"))
    # a stated list of terms against every text
    both = texts.join(bounded(terms), F.lit(True))
    return both.select(ident, "source_term", low.contains(term).alias("inside"), F.regexp_like(low, word_pattern(term, False)).alias("as_word"), F.regexp_like(low, word_pattern(term, True)).alias("as_stem"))


def select_terms(texts: DataFrame, terms: DataFrame, ident: str, most: int = MAX_TERMS) -> DataFrame:
    """The preferred or approved terms that share a word with a text or stand in it, at most `most`, by name."""
    use = terms.where("(preferred OR status = 'approved') AND source_term <> ''")
    tokens = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-zà-ÿ0-9]+)"), F.lit(1)))
    use = use.withColumns({"_words": tokens(F.col("source_term")), "_low": F.trim(F.lower("source_term"))})
    both = texts.withColumn("_tokens", tokens(F.col("text"))).join(bounded(use), F.lit(True))
    hits = both.where(F.arrays_overlap("_tokens", "_words") | F.lower("text").contains(F.col("_low")))
    w = Window.partitionBy(ident).orderBy("source_term")
    return hits.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= most).drop("_words", "_low", "_tokens", "text")
