"""Connected components of narrow edge tables, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v: long); the label is the component's least node.

    Labels spread along edges and jump along labels, so rounds grow with the logarithm of the
    longest path. Each round takes minima with partial aggregation, so a node of many edges
    costs a task one row, and is written to the shared folder.
    """
    edges = stored(edges.filter("u <> v").distinct(), "edges")
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label")
        least = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = least.join(ahead, F.col("label") == F.col("at"), "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = stored(jumped, "labels")
        old = labels.select("node", F.col("label").alias("was"))
        if new.join(old, "node").filter("label <> was").isEmpty():
            return new
        labels = new
