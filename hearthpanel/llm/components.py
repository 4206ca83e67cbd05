"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.store import saved


def components(edges: DataFrame) -> DataFrame:
    """Table of vertex and root for every vertex of `edges` (a, b: bigint); one root per component.

    Each round hooks every vertex to its smallest neighbour, jumps from parents to theirs, and merges the
    edges between the roots so far; a component shrinks to at most half its vertices. Rounds end when no
    edge is left. Minima are taken before the shuffle, and tables are read from storage, so that a vertex
    with any number of edges is split among tasks. Nothing goes to the driver but whether edges are left.
    """
    edges = saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = saved(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select(
            "v", F.least("v", "low").alias("p")), "parents")
        above = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parents = saved(parents.join(above, "p").select("v", F.col("q").alias("p")), "grandparents")
        if roots is None:
            roots = parents.select(F.col("v").alias("vertex"), F.col("p").alias("root"))
        else:
            # A root that is in no edge any more is final.
            moved = roots.join(parents.withColumnRenamed("v", "root"), "root", "left")
            roots = saved(moved.select("vertex", F.coalesce("p", "root").alias("root")), "roots")
        first = edges.join(parents.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
        second = first.join(parents.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = saved(second.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return roots
