"""Connected components of a table of links, by smallest labels and pointer jumping, with every round written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) of every node of links (a, b: long), label being the smallest node that can be reached. Each round
    takes the smallest label of a node and its neighbours and then the label of that label, so long chains shrink
    quickly. Sums are combined before they are shuffled, so a node with very many links is no burden."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = scratch.write(both, f"{tag}-edges")
    labels = scratch.write(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{tag}-0")
    turn = 0
    while True:
        turn += 1
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(roots, "label").select("node", "was", F.least("label", "root").alias("label"))
        found = scratch.write(jumped, f"{tag}-{turn}")
        changed = not found.where("label <> was").isEmpty()
        scratch.drop(f"{tag}-{turn - 1}")
        labels = found.select("node", "label")
        if not changed:
            return labels
