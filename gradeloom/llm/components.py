"""Connected components by contraction: no node, link or label passes through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.registry import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is one node of the component.

    In a round every node goes to the neighbour (or itself) that a hash of the round puts
    first, and the links are carried over to these. A fresh order each round shrinks
    chains and stars alike by a constant factor, so rounds grow with the logarithm.
    Minima are combined before the shuffle, and a node with very many links is split by
    the skew handling of the join. Each round's links are written to the shared folder.
    """
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("p"), c.alias("node"))
        spread = edges.select(F.explode(both).alias("e")).select("e.u", "e.v")
        moved = spread.groupBy(F.col("u").alias("node")).agg(F.min(order(F.col("v"))).alias("m")).select(
            "node", F.least("m", order(F.col("node")))["node"].alias("to")
        )
        moved = written(moved, "moves")
        rounds.append(moved)
        edges = written(
            edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(moved.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "links",
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = rounds[-1].select("node", F.col("to").alias("root"))
    for moved in reversed(rounds[:-1]):
        ahead = found.select(F.col("node").alias("to"), "root")
        found = moved.join(ahead, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return written(found, "roots")
