"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlattice.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of the nodes of links (a, b): component is the least node that links reach.

    Every round gives a node the least label among its own, its neighbours' and its label's label, which halves the way to
    the least node at worst on a star and more on chains. Sums are combined before the shuffle, so a node with many links
    gathers nothing; each round is cut off in the checkpoint folder. No links give no rows.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = checkpointed(closer.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("far", "next")).alias("component")))
        labels = moved.select("node", "component")
        if moved.filter(F.col("was") != F.col("component")).isEmpty():
            return labels
