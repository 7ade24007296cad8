"""Row numbers, latest rows, pages of a list, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .durable import durable


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the running sum of value by keys (none: over all rows) in the given order, the row itself included.

    The rows are dealt out by range of keys and order, so no task holds a whole group: each adds
    up its own rows, and what the group has in the tasks before it. Rows of equal keys and order
    share a task; make the order unique for a total that doesn't depend on chance.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_value", value).repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    dealt = durable(dealt.withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    # a row for each task, and for each key that it begins
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    left, right = dealt.withColumn("_own", own).alias("l"), offsets.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """df with a row number from 1 by keys (none: over all rows) in the given order, as a running total of ones."""
    return running_total(df, keys, order, F.lit(1).cast("long"), name)


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key: an aggregation, so a hot key is reduced before it is dealt."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def islands(df: DataFrame, keys: list[str], order: list[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number of the run that each row belongs to; a run begins where `starts` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def natural_key(col: Column | str, width: int = 12) -> Column:
    """Sort key in which runs of digits count as numbers."""
    parts = F.regexp_extract_all(t.c(col), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
