"""Connected components by contraction, with DataFrame operations only.

In each round every node points to the smallest node around it and the edges
are redrawn between the nodes pointed to, so the graph shrinks until no edge is
left. The order of nodes is their own in the first two rounds, which finishes
stars at once, and a hash that changes with the round after that, which makes
long chains shrink by a constant factor. Every grouping is a partial
aggregation and every join is a plain one between stored tables, which Spark
splits where one node has very many links.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from loomtext.llm.shared import cut, discard, steps


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the
    ``links`` (u, v, of one type that has an order). Self-links, nulls and
    repeats are allowed; no links give no rows."""
    with steps(links.sparkSession):
        edges = cut(links.where("u <> v").select("u", "v").distinct())
        left, first = edges.count(), edges
        rounds: list[DataFrame] = []
        while left:
            k = len(rounds)
            order = F.col if k < 2 else partial(F.xxhash64, F.lit(k))
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            goal = both.groupBy("u").agg(F.min(F.struct(order("v").alias("o"), F.col("v").alias("v"))).alias("best"))
            goal = cut(goal.select("u", F.when(order("u") <= F.col("best.o"), F.col("u")).otherwise(F.col("best.v")).alias("to")))
            rounds.append(goal)
            drawn = edges
            for side in ("u", "v"):
                drawn = drawn.join(goal.select(F.col("u").alias(side), "to"), side).drop(side).withColumnRenamed("to", side)
            drawn = cut(drawn.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
            if edges is not first:
                discard(edges)
            edges, left = drawn, drawn.count()
        labels = first.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
        for goal in rounds:
            labels = labels.join(goal.select(F.col("u").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = cut(labels)
        least = labels.groupBy("label").agg(F.min("node").alias("component"))
        out = cut(labels.join(least, "label").select("node", "component"))
        discard(labels, first, *rounds, *([edges] if edges is not first else []))
        return out
