"""Connected components of a graph by minimum labels with pointer jumping, lineage cut in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs, or of structs -> node, component (the smallest node it reaches). Nodes without edges don't appear.

    Each round hooks every component onto the smallest component next to it and then follows labels of labels, so
    the rounds grow with the logarithm of the longest chain. A round ends in one counted flag, never in collected
    nodes. Labels of a hub's neighbours are minima, merged before they are shuffled.
    """
    both = edges.where("a <> b").select("a", "b")
    both = stash(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("__c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("__c").alias("__m"))
        new = labels.join(seen, "node").select("node", F.col("component").alias("__old"), F.least("component", "__m").alias("component"))
        # hook: the smallest label that any member of a component has seen becomes the label of its root
        hook = new.groupBy(F.col("__old").alias("__root")).agg(F.min("component").alias("__to"))
        new = stash(new.join(hook, F.col("__old") == F.col("__root")).select("node", "__old", F.least("component", "__to").alias("component")), "cc-round")
        jump = new.select(F.col("node").alias("__n"), F.col("component").alias("__c2"))
        new = new.join(jump, F.col("component") == F.col("__n"), "left").select("node", "__old", F.least("component", F.coalesce("__c2", "component")).alias("component"))
        new = stash(new, "cc-jump")
        if new.where("component <> __old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
