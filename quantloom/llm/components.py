"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Label every node of ``links(a, b)`` with the least node it reaches: returns (node, label).

    Each round takes the least label among a node's neighbours, then the label of its label, so that paths
    shorten by doubling; each round is written to the shared folder. Self links and repeated links are allowed,
    links with a null end are ignored, an empty table gives an empty result.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        told = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("said")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("said").alias("said"))
        )
        step = labels.join(told, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "said").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = materialize(
            step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels"
        )
        done = after.where(F.col("was") != F.col("label")).isEmpty()
        labels = after.select("node", "label")
        if done:
            return labels
