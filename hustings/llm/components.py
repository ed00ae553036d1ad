"""Connected components over an edge table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Edges (a, b: long) to (node, label): label is the smallest node that node reaches.

    Each round every node takes the smallest label among itself and its neighbours, then the
    label of its label; paths shrink by more than half a round. The graph never reaches the
    driver, which only reads the number of labels that changed. Every round is a written table.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = scratch.save(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        moved = scratch.save(step.join(far, "new").select("node", "label", F.least("new", "next").alias("new")), "labels")
        changed = moved.where("label <> new").limit(1).count()
        scratch.drop(labels)
        labels = moved.select("node", F.col("new").alias("label"))
        labels.scratch_path = moved.scratch_path
        if not changed:
            scratch.drop(both)
            return labels
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")
