"""Connected components of a link table, by least labels and pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: every node of the links, with the least node that can be reached from it.

    Each round takes the least label among a node's neighbours (partial sums keep a hub's neighbours apart), then the
    label of that label, so paths halve. Rounds end when nothing changed. Self-links and repeated links do no harm.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    edges = common.written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = common.written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node", "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("to")
        )
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("over"))
        moved = common.written(
            step.join(jump, "to", "left").select(
                "node",
                F.least("to", F.coalesce("over", "to")).alias("label"),
                (F.least("to", F.coalesce("over", "to")) != F.col("label")).alias("changed")
            ),
            "labels"
        )
        labels = moved.select("node", "label")
        if not moved.where("changed").take(1):
            return labels
