"""Connected components by hooking, pointer jumping and contraction, on saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, spread_join


def components(edges: DataFrame, tables: SharedTables) -> DataFrame:
    """node, component (its smallest node) for all nodes of edges a, b (longs).

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their roots, and
    contracts the edges to roots. Minima are aggregated before the shuffle, and the rows of a hub or of a giant component
    are dealt over many tasks in each join. Rounds and jumps are logarithmic in the size.
    """
    edges = tables.save(edges.select("a", "b").filter("a <> b").distinct())
    labels = tables.save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = tables.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:
            ahead = hooks.select(F.col("node").alias("up"), F.col("up").alias("far"))
            jumped = tables.save(spread_join(hooks, ahead, ["up"], "node").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            tables.drop(hooks)
            hooks = jumped
            if not moved:
                break
        up = hooks.select(F.col("node").alias("component"), "up")
        new = tables.save(spread_join(labels, up, ["component"], "node", "left").select("node", F.coalesce("up", "component").alias("component")))
        tables.drop(labels)
        labels = new
        to_a, to_b = hooks.select(F.col("node").alias("a"), F.col("up").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        half = tables.save(spread_join(edges, to_a, ["a"], "b"))
        contracted = spread_join(half, to_b, ["b"], "a").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b")
        new = tables.save(contracted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tables.drop(edges)
        tables.drop(half)
        edges = new
    return labels


def smallest(labels: DataFrame, ids: DataFrame, tables: SharedTables) -> DataFrame:
    """node, component_id: the smallest id among those of a component's nodes; ids: node, id for every node of labels."""
    named = tables.save(labels.join(ids, "node"))
    heads = named.groupBy("component").agg(F.min("id").alias("component_id"))
    return tables.save(spread_join(named, heads, ["component"], "node").select("node", "component_id"))
