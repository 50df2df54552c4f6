"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); the label is one of the nodes of the component.

    Each round hooks every component to its smallest neighbour, shortens the paths and contracts the edges;
    their number at least halves, so a few rounds do. All tables live in the shared folder.
    """
    labels = None
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "graph-edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))
        hooks = stored(hooks, "graph-hooks")
        for _ in range(2):  # parents of parents
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hooks = stored(hooks.join(up, "parent").select("node", F.col("above").alias("parent")), "graph-hooks")
        step = hooks.select(F.col("node").alias("label"), "parent")
        if labels is None:
            labels = hooks.select("node", F.col("parent").alias("label"))
        else:
            moved = labels.join(step, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
            labels = stored(moved, "graph-labels")
        a = hooks.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = stored(moved.filter("a <> b").distinct(), "graph-edges")
    return labels
