"""Connected components of a table of links, as joins and aggregates only.

Large-star and small-star steps alternate (Kiveris et al. 2014): each node's
larger, then smaller neighbours are hung on its least neighbour, until
nothing changes.  Each round is written to the shared folder; links never
leave the executors.  A node with many links is no bottleneck: its least
neighbour is found by partial aggregates, and the join back is one that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the
    smallest node that can be reached.  No edges give no rows; repeated edges
    and edges from a node to itself do no harm; null ends are left out."""
    state = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct()
    state = _shared.written(state, "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = mark(state)
    while last[0]:
        after = _shared.written(_small_star(_large_star(state)), "stars")
        _shared.remove(state)
        state, now = after, mark(after)
        if now == last:
            break
        last = now
    roots = state.select(F.col("b").alias("node")).distinct()
    return state.select(
        F.col("a").alias("node"),
        F.col("b").alias("component"),
    ).unionByName(roots.select("node", F.col("node").alias("component")))
