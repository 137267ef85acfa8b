"""Order-dependent work on small arrays as column expressions, so that a group needs no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_over(candidates: Column) -> Column:
    """Places that lose when candidate pairs are settled in order; a pair with a place that has lost already settles nothing.

    candidates: array of (pos_a, pos_b, loser), in the order in which they are to be settled.
    """
    none = F.array().cast("array<int>")
    return F.aggregate(candidates, none, lambda gone, c: F.when(F.array_contains(gone, c["pos_a"]) | F.array_contains(gone, c["pos_b"]), gone).otherwise(F.array_append(gone, c["loser"])))


def taken(rows: Column, rejects: Callable[[Column, Column], Column], empty: str) -> Column:
    """Rows taken one by one, unless one that was taken before rejects them; empty: the type of the result."""
    return F.aggregate(rows, F.array().cast(empty), lambda kept, r: F.when(F.exists(kept, lambda k: rejects(k, r)), kept).otherwise(F.array_append(kept, r)))


def labels(n: Column, edges: Column) -> Column:
    """For the numbers 1 to n the smallest one that edges (a, b) join each with; edges in any order."""
    alone = F.sequence(F.lit(1), n)

    def join(now: Column, e: Column) -> Column:
        a, b = F.element_at(now, e["a"]), F.element_at(now, e["b"])
        return F.transform(now, lambda x: F.when((x == a) | (x == b), F.least(a, b)).otherwise(x))

    return F.aggregate(F.coalesce(edges, F.array().cast("array<struct<a:int,b:int>>")), alone, join)
