"""Joins by range and containment, with an equi-join on bins so that neither side is held against all of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, key: list[str], point: str, lo: str, hi: str, bin_size: int, how: str = "inner") -> DataFrame:
    """points with the spans of the same key that hold them: lo <= point <= hi, both ends in.

    A span is listed under each bin that it touches and a point under its own, so rows meet by
    (key, bin); `how` may be inner, left, left_semi or left_anti.
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))))
    p, s = p.alias("p"), s.alias("s")
    same = F.col("p._bin") == F.col("s._bin")
    for k in key:
        same = same & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    joined = p.join(s, same & (F.col(f"p.{point}") >= F.col(f"s.{lo}")) & (F.col(f"p.{point}") <= F.col(f"s.{hi}")), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bin")
    return joined.select("p.*", *[F.col(f"s.{c}") for c in spans.columns if c not in key]).drop("_bin")


def as_of(points: DataFrame, events: DataFrame, key: list[str], at: str, since: str, value: str, bin_size: int) -> DataFrame:
    """points with the value of the last event of the key at or before them, null where none.

    Points and events meet by (key, bin), so a key that holds most rows is spread; what a bin
    inherits comes from a running last value over the bins of a key, a row for each.
    """
    cols = points.columns
    e = events.select(*key, F.col(since).alias(at), F.col(value).alias("_v")).withColumn("_bin", F.floor(F.col(at) / bin_size))
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    ends = e.groupBy(*key, "_bin").agg(F.max_by("_v", at).alias("_last"))
    bins = p.select(*key, "_bin").distinct().join(ends, [*key, "_bin"], "full")
    earlier = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*key, "_bin", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    both = p.withColumn("_kind", F.lit(1)).unionByName(e.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key, "_bin").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return near.join(bins, [*key, "_bin"]).select(*cols, F.coalesce("_near", "_carried").alias(value))
