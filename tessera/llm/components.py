"""Connected components of links, by smallest-label propagation with jumps.

Every step is a join and an aggregation over tables in the shared folder; links
never reach the driver. Labels take the smallest label of a neighbour and then
the label of their label, so the number of rounds follows the logarithm of the
longest path rather than its length in common cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stage


def components(links: DataFrame, a: str, b: str, stage: Stage) -> DataFrame:
    """(node, component): the smallest node that links reach from it. Nodes without links have no row."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stage.keep(pairs.union(pairs.select("v", "u")).distinct())
    labels = stage.keep(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("near"))
        took = stage.keep(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid")))
        jump = took.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        after = stage.keep(took.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        changed = after.where("component <> old").limit(1).count()
        stage.drop(labels)
        stage.drop(took)
        labels = after.select("node", "component")
        if not changed:
            stage.drop(both)
            return labels
