"""Bringing edited files back, and saving drafts: each row's outcome, without touching what is approved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(incoming: DataFrame, units: DataFrame) -> DataFrame:
    """incoming(segment_id, target, status) against units(segment_id, target, status) -> (segment_id, outcome).

    not_found; skipped (no target); conflict (approved, and the text differs); unchanged; approved; updated.
    """
    u = units.select("segment_id", F.col("target").alias("old"), F.col("status").alias("was"), F.lit(True).alias("known"))
    j = incoming.join(u, "segment_id", "left")
    same = F.coalesce("old", F.lit("")) == F.col("target")
    outcome = (
        F.when(F.col("known").isNull(), "not_found").when(F.coalesce("target", F.lit("")) == "", "skipped").when((F.col("was") == "approved") & ~same, "conflict")
        .when((F.col("status") == "approved") & (F.col("was") != "approved"), "approved").when(same, "unchanged").otherwise("updated")
    )
    return j.select("segment_id", outcome.alias("outcome"))


def upserted(units: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """units with the rows of changes in place of those of the same key, and the new ones."""
    return units.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def saved_drafts(units: DataFrame, drafts: DataFrame) -> DataFrame:
    """units(segment_id, target, status, score) with drafts(segment_id, draft): approved rows as they were, changed ones
    machine drafts without a score."""
    j = units.join(drafts, "segment_id", "left")
    change = (F.col("status") != "approved") & F.col("draft").isNotNull() & ~F.col("draft").eqNullSafe(F.col("target"))
    return j.select("segment_id", F.when(change, F.col("draft")).otherwise(F.col("target")).alias("target"), F.when(change, "machine_draft").otherwise(F.col("status")).alias("status"), F.when(~change, F.col("score")).alias("score"))


def versions(before_after: DataFrame) -> DataFrame:
    """(segment_id, before, after) -> two rows for each edit: before it and after it."""
    return before_after.select("segment_id", F.explode(F.array(F.struct(F.lit(True).alias("is_before"), F.col("before").alias("text")), F.struct(F.lit(False).alias("is_before"), F.col("after").alias("text")))).alias("v")).select("segment_id", "v.*")


def first_clean(attempts: DataFrame) -> DataFrame:
    """attempts(segment_id, attempt, response, hard) -> the first without hard errors; none: no row."""
    return attempts.where("not hard").groupBy("segment_id").agg(F.min("attempt").alias("attempt"), F.min_by("response", "attempt").alias("response"))


def longest(translations: DataFrame) -> DataFrame:
    """translations(segment_id, seq, target): one for each id, the longest, the first of equal ones."""
    return translations.groupBy("segment_id").agg(F.max_by("target", F.struct(F.length(F.coalesce("target", F.lit(""))), -F.col("seq"))).alias("target"))
