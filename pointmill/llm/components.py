"""Connected components of a graph whose edges are rows, by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import cut, salted_join


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b: long).

    Each round takes the smallest label among a node's neighbours and then that label's own label; rounds end when no
    label changes. Nothing is gathered by node; a hub with any number of neighbours, and a label with any number of nodes, is
    dealt into parts where it is joined. An empty table gives an empty result; repeated edges and loops change nothing."""
    pairs = edges.where("a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = salted_join(both, labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), ["b"], F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")))
        above = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(salted_join(lower, above, ["label"], F.col("node"), "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
