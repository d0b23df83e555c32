"""Connected components of links between 64-bit nodes, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); the label is the component's smallest node.

    Each round gives a node the least label of itself, its neighbours and its label's label, so the
    number of rounds grows with the logarithm of a component's width, not with its size. Neighbours are
    aggregated before the shuffle, so a node with very many links isn't hot. Every round is
    a written table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both)
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # hook a node's label to what its members see, then take the label's label
        seen = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        hook = seen.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        hooked = seen.join(hook.withColumnRenamed("node", "root"), F.col("label") == F.col("root"), "left").select(
            "node", "label", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = hooked.select(F.col("node").alias("at"), F.col("low").alias("next"))
        new = materialize(hooked.join(jump, F.col("low") == F.col("at"), "left").select(
            "node", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("was")))
        if not new.where("label <> was").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
