"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): nodes of a component share one root.

    Each round every node takes the least of itself and its neighbours, and edges are carried over to these labels;
    the graph shrinks until no edge is left. Labels are then followed from round to round.
    """
    edges = stored(edges.select("a", "b"), "edges")
    rounds = []
    while True:
        both = edges.union(edges.select("b", "a"))
        labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")), "labels")
        rounds.append(labels)
        at_a, at_b = labels.select(F.col("node").alias("a"), F.col("root").alias("x")), labels.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stored(edges.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    out = rounds[0]
    for labels in rounds[1:]:
        further = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
