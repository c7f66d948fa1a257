"""Connected components of an edge table, with durable rounds and no driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over the edges (a, b), both bigint.

    Each round gives every node the smallest label among itself and its neighbours, then follows that
    label's own label (pointer jumping), so a path shrinks by half a round. Minima are combined before the
    shuffle, so a hub with a third of all edges costs its neighbours' rows only. Every round is written
    out, and the loop ends when a round changes nothing. Nulls take no part.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), gathered=True)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels = durable(labels, gathered=True)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stepped.join(roots, "label", "left").select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label"))
        jumped = durable(jumped, gathered=True)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
