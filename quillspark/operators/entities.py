"""Mentions to entities: confidence, gender, merged clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

#: fixed values: weights of a mention's form, and the margin between two readings
WEIGHTS = {"PROP": 1.0, "NOM": 0.7, "PRON": 0.4}
OTHER_WEIGHT, MARGIN = 0.5, 0.05


def confidence(mentions: DataFrame) -> DataFrame:
    """mentions(coref, prop) -> (coref, mentions, confidence): mean weight, drawn to 0.3 where mentions are few."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("prop")], F.lit(OTHER_WEIGHT))
    n = F.count("*")
    damped = F.avg(weight) * (n / (n + 2.0)) + 0.3 * (2.0 / (n + 2.0))
    return mentions.groupBy("coref").agg(n.alias("mentions"), F.round(F.least(F.lit(1.0), damped) + 1e-9, 3).alias("confidence"))


def gender(counts: DataFrame) -> DataFrame:
    """counts(coref, pron, n) -> (coref, p, gender): the commonest pronoun, unknown where the next is close."""
    total = Window.partitionBy("coref")
    s = counts.withColumn("p", F.col("n") / F.sum("n").over(total))
    w = total.orderBy(F.col("p").desc(), "pron")
    s = s.withColumns({"k": F.row_number().over(w), "after": F.lead("p").over(w)}).where("k = 1")
    return s.select("coref", F.round("p", 3).alias("p"), F.when(F.col("p") - F.coalesce("after", F.lit(0.0)) < MARGIN, "unknown").otherwise(F.col("pron")).alias("gender"))


def merged_clusters(clusters: DataFrame) -> DataFrame:
    """clusters(coref, canonical, mentions) -> one row for each name: the largest cluster's name, all mentions."""
    best = F.max_by("canonical", F.struct("mentions", -F.col("coref")))
    return clusters.groupBy(t.name_key("canonical").alias("name_key")).agg(best.alias("canonical"), F.sum("mentions").alias("mentions"), F.count("*").alias("clusters"))


def chapter_sets(mentions: DataFrame, chapter: str, entity: str) -> DataFrame:
    """Entities of each chapter, and which are new against the chapter before."""
    sets = mentions.groupBy(chapter).agg(F.collect_set(entity).alias("now"))
    before = sets.select((F.col(chapter) + 1).alias(chapter), F.col("now").alias("before"))
    return sets.join(before, chapter, "left").withColumn("introduced", F.array_except("now", F.coalesce("before", F.array().cast(sets.schema["now"].dataType))))
