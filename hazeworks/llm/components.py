"""Connected components of a graph given as a table of links, by alternating large and small stars.

Every round is two joins and aggregations over the links, and a count of ends to see if all are stars; the links never leave
the executors. Rounds are written to the shared folder. A hub with most links costs a combined minimum and a join that AQE can split, never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeworks.llm.common import materialize


def _star(both: DataFrame) -> DataFrame:
    """Neighbour pairs (u, v) with m, the least of u and its neighbours in ``both``."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _either(x: str, y: str, a: str, b: str) -> Column:
    """Two rows, (x, y) and (y, x), as columns a and b."""
    pair = lambda p, q: F.struct(F.col(p).alias(a), F.col(q).alias(b))
    return F.inline(F.array(pair(x, y), pair(y, x)))


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link; the component is the smallest node reachable.

    Loops and repeated links are harmless; links with a null end are left out. No links give no rows.
    """
    real = links.where(F.col(a) != F.col(b))
    edges = real.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    edges = materialize(edges, "links")
    for _ in range(most_rounds):
        large = _star(edges.select(_either("child", "parent", "u", "v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = _star(large).select(_either("v", "u", "child", "_"), F.col("m").alias("parent")).select("child", "parent")
        edges = materialize(hung.where("child != parent").distinct(), "links")
        # All stars: nobody is both child and parent, and every child has one parent.
        ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots)
