"""Connected components of a graph of longs, by hooking to smaller labels and pointer jumping.

Each round is two equi-joins and an aggregation over the edges; labels are written to the
checkpoint folder, which all executors share, so that lineage stays short and a lost
executor costs one round's tasks. Nothing is collected but counts.

A label that more than HOT nodes share, and more than one in 10^5 of all, is broadcast with its
own label rather than joined by a shuffle: there are at most 10^5 of these in any graph, and no
task gathers the nodes of a large component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable

#: nodes that a label may have in the shuffled join, or one in SHARE of all nodes if that is more
HOT, SHARE = 1000, 100_000


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, fewer where many a name the same few b: each a keeps its smallest b, and the
    others that it names are linked to that one, once for all such a."""
    named = edges.where("a is not null and b is not null and a <> b").groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("all"))
    # one pass, as a union of the two kinds would compute the edges twice
    return named.select(F.explode(F.expr("concat(array(struct(a, all[0] as b)), transform(slice(all, 2, size(all) - 1), x -> struct(all[0] as a, x as b)))")).alias("e")).select("e.a", "e.b").distinct()


def components(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that each node of an edge can reach.

    With ranks (node, rank) of all nodes, the smallest is that of the smallest rank, null ranks last, and the
    result has a column rank, the component's.
    """
    # each edge in both directions by one pass, as a union would hold, and run, the plan of the edges twice
    both = edges.where("a is not null and b is not null and a <> b").select(F.explode(F.expr("array(struct(a as u, b as v), struct(b as u, a as v))")).alias("e"))
    both = durable(both.select("e.u", "e.v").distinct())
    nodes = both.select(F.col("u").alias("node")).distinct()
    nodes = nodes.withColumn("rank", F.lit(None).cast("long")) if ranks is None else nodes.join(ranks, "node")
    labels = durable(nodes.select("node", F.struct(F.col("rank").isNull().alias("none"), "rank", "node").alias("label")))
    hot = max(HOT, labels.count() // SHARE)
    while True:
        # the smallest label among the neighbours, then the label of the node that the label names
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        hooked = durable(labels.join(near, labels.node == near.u).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"), F.least("label", "m")["node"].alias("at")))
        jump = hooked.where("node <> at").select(F.col("node").alias("from"), F.col("label").alias("to"))
        # how many nodes name each node, and its own label, in one aggregation
        named = hooked.select(F.explode(F.expr("array(struct(at, 1 as n, if(false, label, null) as to), struct(node as at, 0 as n, label as to))")).alias("x")).select("x.*")
        crowded = named.groupBy("at").agg(F.sum("n").alias("n"), F.max("to").alias("crowd_to")).where(F.col("n") > hot).select("at", "crowd_to")
        split = hooked.join(F.broadcast(crowded), "at", "left")
        rest = split.where("crowd_to is null").join(jump, F.col("at") == F.col("from"), "left").select("node", "was", F.coalesce("to", "label").alias("label"))
        new = durable(split.where("crowd_to is not null").select("node", "was", F.col("crowd_to").alias("label")).unionByName(rest))
        labels = new.select("node", "label")
        if not new.where("was <> label").count():  # one job, where isEmpty() of nothing takes one for each few partitions
            return labels.select("node", F.col("label.node").alias("component"), *([] if ranks is None else [F.col("label.rank").alias("rank")]))
