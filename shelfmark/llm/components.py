"""Connected components of a graph of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """One row per linked node: node, component (the smallest node reached).

    links: columns a and b of one ordered type; direction, repetition and self-links make no difference, nulls are
    dropped, no links give no rows. Each round takes the smallest label among the neighbours and then the label of that
    label, so the number of rounds grows with the logarithm of the longest path. Labels are cut off from their lineage
    by a checkpoint in the shared folder every round; only counts reach the driver.
    """
    clean = links.where("a is not null and b is not null").select("a", "b")
    both = checkpoint(clean.union(clean.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["n"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        after = checkpoint(lower.join(jump, F.col("label") == F.col("at"), "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        if after.where("label <> was").limit(1).count() == 0:
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
