"""Connected components of a table of edges, by contraction. No node list, edge list or component leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import settled


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b; integers); component is the smallest node reachable.

    Each round every node points to its smallest neighbour (an aggregate, so a node with a third of all edges is combined
    before the shuffle), pointers are followed once more, and the edges are rewritten between what the nodes point to.
    Every node that has a smaller neighbour disappears, so the edges shrink to nothing in a logarithmic number of rounds.
    Each round reads settled tables: lineage stays short, a lost executor repeats one step, and adaptive execution may split
    the rows of a hot node in the joins. Null ends and loops are left out; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a is not null and b is not null and a <> b"
    )
    pairs = settled(pairs.distinct(), purpose)
    found: DataFrame | None = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        step = settled(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), purpose)
        onward = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
        step = settled(step.join(onward, "to").select("node", "root"), purpose)
        if found is None:
            found = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            found = settled(
                found.join(moved, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), purpose
            )
        left = step.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        again = pairs.join(left, "a").join(right, "b").where("_a <> _b")
        pairs = settled(again.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct(), purpose)
        if pairs.isEmpty():
            return found.select("node", F.col("root").alias("component"))
