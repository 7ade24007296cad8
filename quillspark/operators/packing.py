"""Greedy packing of rows in order, with limits on weight and on rows.

A pack closes when the next row would pass a limit. Within a group this is a fold, so a
group's weights (not its texts) are gathered as one array; the fold keeps the beginnings of
packs only, and rows find their pack by the last beginning before them. A group is a chapter
or a document, which is what a pack may not cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: token limits of a block
SOURCE_BUDGET, CONTEXT_RESERVE, OUTPUT_RESERVE = 16_384, 2_500, 16_384
#: fixed values: read-only neighbours of a block
PRECEDING, FOLLOWING = 2, 1


def packed(df: DataFrame, keys: list[str], order: str, weight: Column, limit: int, max_rows: int | None = None, before: bool = True, name: str = "block") -> DataFrame:
    """(keys, order, weight, block): the pack of each row, from 0.

    before: a row that would pass the limit opens a pack; otherwise a pack closes once it has reached it.
    """
    rows = df.select(*keys, F.col(order).cast("long").alias(order), weight.cast("long").alias("weight"))
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "weight"))).alias("rows"))
    begins = f"array<struct<{order}:bigint,{name}:bigint>>"
    zero = F.struct(F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("n"), F.array().cast(begins).alias("out"))

    def step(a, x):
        full = (a["total"] + x["weight"] > limit) if before else (a["total"] >= limit)
        if max_rows:
            full = full | (a["n"] >= max_rows)
        full = full & (a["n"] > 0) | (a["block"] < 0)
        block = a["block"] + F.when(full, 1).otherwise(0)
        out = F.when(full, F.concat(a["out"], F.array(F.struct(x[order].alias(order), block.alias(name))))).otherwise(a["out"])
        return F.struct(block.alias("block"), (F.when(full, 0).otherwise(a["total"]) + x["weight"]).alias("total"), (F.when(full, 0).otherwise(a["n"]) + 1).alias("n"), out.alias("out"))

    starts = g.select(*keys, F.inline(F.aggregate("rows", zero, step)["out"]))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for k in [*keys, order]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    found = rows.alias("l").join(starts.alias("r"), same, "left").select(*[F.col(f"l.{c}") for c in rows.columns], F.col(f"r.{name}"))
    return found.withColumn(name, F.last(name, ignorenulls=True).over(w))


def blocks(rows: DataFrame, keys: list[str], order: str, limit: int = SOURCE_BUDGET) -> DataFrame:
    """Of packed(): a row for each block, with its tokens, budget and neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    ordered = rows.withColumns({"_back": F.collect_list(order).over(w.rowsBetween(-PRECEDING, -1)), "_on": F.lead(order).over(w)})
    b = ordered.groupBy(*keys, "block").agg(
        F.count("*").alias("segments"), F.sum("weight").alias("source"), F.min(order).alias("first"), F.max(order).alias("last"),
        F.min_by("_back", order).alias("preceding"), F.max_by("_on", order).alias("following"),
    )
    return b.withColumns({"total": F.col("source") + CONTEXT_RESERVE + OUTPUT_RESERVE, "oversized": F.col("source") > limit})
