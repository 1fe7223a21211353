"""Connected components of an edge table, distributed.

Contraction: every node that has a smaller neighbour hooks onto its smallest
one, which gives a forest; pointer jumping turns its trees into stars; the
edges are rewritten between roots, and the next round works on what is left.
Nodes, edges and labels stay in tables; each step is a join of tables on disk,
so AQE can split a hub that holds a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut


def _stars(forest: DataFrame) -> DataFrame:
    """(node, parent) with every parent a root; parents are smaller than their nodes."""
    while True:
        up = forest.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        step = cut(forest.join(up, F.col("parent") == F.col("_n"), "left")
                   .select("node", F.coalesce("_p", "parent").alias("parent"), F.col("_p").isNotNull().alias("moved")),
                   "jump")
        forest = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return forest


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable from each node that isn't itself the smallest.

    Nodes without a row are their own component.  Null ends, loops and repeated
    edges are ignored; an empty edge table gives an empty result.
    """
    left = cut(edges.select(F.least(u, v).alias("lo"), F.greatest(u, v).alias("hi"))
               .filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("lo") < F.col("hi"))).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        hooks = cut(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks")
        stars = _stars(hooks)
        rounds.append(stars)
        a = stars.select(F.col("node").alias("lo"), F.col("parent").alias("_lo"))
        b = stars.select(F.col("node").alias("hi"), F.col("parent").alias("_hi"))
        joined = (left.join(a, "lo", "left").join(b, "hi", "left")
                  .select(F.coalesce("_lo", "lo").alias("x"), F.coalesce("_hi", "hi").alias("y")).filter("x <> y"))
        left = cut(joined.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
    if not rounds:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        earlier = rounds.pop()
        labels = cut(earlier.join(later, F.col("parent") == F.col("_n"), "left")
                     .select("node", F.coalesce("_p", "parent").alias("parent")).unionByName(labels), "labels")
    return labels.select("node", F.col("parent").alias("component"))
