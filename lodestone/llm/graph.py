"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of `edges` (a, b); a component is named by its smallest node.

    Labels move to the least label among neighbours and then to that label's own label, so the rounds grow with the logarithm of a
    component's width. Minima are taken before the shuffle, so hubs cost a row per task. Every round ends in a table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both.withColumnsRenamed({"a": "node", "b": "other"}), "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "other", "component": "heard"}), "other").groupBy("node").agg(F.min("heard").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        step = cut(near.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("component"), (F.least("near", F.coalesce("far", "near")) < F.col("component")).alias("moved")), "labels")
        if step.filter("moved").isEmpty():
            return step.select("node", "component")
        labels = step.drop("moved")
