"""Connected components of link tables, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Of links (a, b): each node's least reachable node, as (node, component).

    Each round a node takes the least label of its neighbours and then its label's label, so paths shorten by
    halves; labels only fall, and rounds end when none does. Labels are pre-aggregated before each shuffle and
    written to the shared folder after each round; only whether any changed comes to the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.table(both, "cc-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    table = scratch.table(labels, "cc-labels")
    labels, moves = table, True
    while moves:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("hop"))
        new = labels.join(hop, "component", "left").join(near, "node", "left")
        new = new.select("node", F.col("component").alias("old"), F.least(F.coalesce("hop", "component"), "component", F.coalesce("near", "component")).alias("component"))
        new = scratch.table(new, "cc-labels")
        moves = not new.where("old <> component").isEmpty()
        scratch.drop(table)
        table, labels = new, new.select("node", "component")
    scratch.drop(both)
    return labels
