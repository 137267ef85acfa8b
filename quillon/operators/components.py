"""Connected components of an edge table, by forests of smallest neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.work import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b) but the roots themselves; a root is the smallest node it stands for.

    Each round gives every node that has smaller neighbours the smallest of them as its parent, follows parents to the
    trees' roots, and keeps the edges between different roots. At least half of the nodes that still have edges lose them
    in a round. All state is in tables, which go when the next has been written; the driver sees only whether one is empty.

    Defined cases: an empty table gives no rows; repeated edges and edges of a node to itself change nothing; edges with a null end
    are ignored; other columns are ignored, whatever their names.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    found, last = None, None
    while True:
        edges = materialise(edges, "edges")
        if last is not None:
            discard(*last)
        if edges.isEmpty():
            break
        parent = materialise(edges.groupBy("a").agg(F.min("b").alias("p")), "parents")
        while True:
            before = parent
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = materialise(parent.select("a", "p").join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parents")
            discard(before)
            if parent.where("moved").isEmpty():
                break
        written, parent = parent, parent.select("a", "p")
        if found is None:
            found = materialise(parent, "roots")
        else:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            before = found
            found = materialise(found.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")).unionByName(parent), "roots")
            discard(before)
        last = (edges, written)
        left, right = parent.select("a", F.col("p").alias("ra")), parent.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        edges = (
            edges.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
        )
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.select(F.col("a").alias("node"), F.col("p").alias("root"))
